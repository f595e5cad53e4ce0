"""Property graphs as two DataFrames, with operators that compile to ordinary Spark plans."""
