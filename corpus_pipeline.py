"""The corpus pipeline: documents in, packed training sequences out.

STAGES are applied one after another; each result is written as Parquet and read again as the next stage's documents:

1. quality classifier (positive-unlabelled): documents with a score below 0.3 go;
2. MinHash near-duplicates (chosen-path join, five-word shingles, similarity of 0.8 or more): one document of each group stays;
3. benchmark decontamination (BM25 with block-max WAND): documents that hold a test item go;
4. personal data (weak supervision): spans are replaced by their kind in angle brackets;
5. packing: the pieces of the remaining documents in sequences of at most 4096 tokens.

All but the last return the columns of documents, whatever their names. Stages 1 and 3 judge each row by its own text, so rows that share an id, or have none, go
one by one. In stage 2 an id is one document with all its texts; of rows that repeat an id with equal text one stays. Documents with a
null id are compared with no others, and of those with equal text one stays. Null texts are empty; an empty table gives no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import chosen_path, decontam, packing, pii, quality
from graphloom.llm.common import shared_dir, table
from graphloom.llm.queries import tokenizer

#: SQL cannot express training, signatures or packing; tests/llm/test_pipeline.py compares the stages with brute force.
ORACLE_SQL = None


def _fresh(docs: DataFrame, name: str) -> str:
    """``name``, made longer until no column has it."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """``docs`` without the rows of a rejected id and text (doc_id, text_hash)."""
    key, text = _fresh(docs, "row_id"), _fresh(docs, "row_text")
    marked = docs.withColumns({key: F.col("doc_id").cast("long"), text: F.xxhash64(F.col("text").cast("string"))})
    gone = rejected.select(F.col("doc_id").alias(key), F.col("text_hash").alias(text)).distinct()
    return marked.join(gone, marked[key].eqNullSafe(gone[key]) & (marked[text] == gone[text]), "left_anti").drop(key, text)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _without(docs, quality.score(docs, table(spark, sf_dir, "labels")).where("predicted = 0"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    key, text = _fresh(docs, "row_id"), _fresh(docs, "row_text")
    dropped = chosen_path.near_duplicates(docs, words=5, threshold=0.8).where("NOT kept").select(F.col("doc_id").alias(key)).distinct()
    rest = docs.withColumn(key, F.col("doc_id").cast("long")).join(dropped, key, "left_anti").drop(key)
    # repeated rows are copies too; the join has already brought the rows of an id together
    return rest.withColumn(text, F.sha2(F.col("text").cast("string"), 256)).dropDuplicates(["doc_id", text]).drop(text)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _without(docs, decontam.contaminated(docs, table(spark, sf_dir, "benchmark")))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, tokenizer())


STAGES = [
    ("quality", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    at = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
    return docs
