"""Graphs from the relational test tables. Id spaces are kept apart: id = key * 8 + type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import dealt, parts

CUSTOMER, SUPPLIER, PART, ORDER, NATION, REGION, USER, EVENT = range(8)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vertex(key: Column | str, kind: int) -> Column:
    return (F.col(key) if isinstance(key, str) else key).cast("bigint") * 8 + kind


def part_supplier_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part -> supplier, an edge for each line item."""
    return table(spark, sf_dir, "lineitem").select(vertex("l_partkey", PART).alias("src"), vertex("l_suppkey", SUPPLIER).alias("dst"), F.col("l_quantity").cast("bigint").alias("weight"), "l_extendedprice")


def part_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part -> supplier with summed quantity."""
    rows = part_supplier_rows(spark, sf_dir).select("src", "dst", "weight")
    return dealt(rows, rows.count(), "src", "dst").groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer -> nation, supplier -> nation, nation -> region, order -> customer, with types and weights."""
    parts = [
        ("customer", "c_custkey", CUSTOMER, "c_nationkey", NATION),
        ("supplier", "s_suppkey", SUPPLIER, "s_nationkey", NATION),
        ("nation", "n_nationkey", NATION, "n_regionkey", REGION),
        ("orders", "o_orderkey", ORDER, "o_custkey", CUSTOMER),
    ]
    out = None
    for name, a, ta, b, tb in parts:
        src = vertex(a, ta)
        df = table(spark, sf_dir, name).select(
            src.alias("src"), F.lit(ta).cast("short").alias("src_type"), vertex(b, tb).alias("dst"), F.lit(tb).cast("short").alias("dst_type"), (F.lit(1) + F.pmod(src, F.lit(5))).alias("weight")
        )
        out = df if out is None else out.unionAll(df)
    return out


def copurchased(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of one order, smaller key first. Lines move once, by order."""
    rows = table(spark, sf_dir, "lineitem")
    n = rows.count()
    lines = rows.select("l_orderkey", "l_partkey").repartition(parts(spark, n), "l_orderkey").distinct()
    pairs = lines.alias("a").join(lines.alias("b"), "l_orderkey").where("a.l_partkey < b.l_partkey")
    return dealt(pairs.select(vertex(F.col("a.l_partkey"), PART).alias("src"), vertex(F.col("b.l_partkey"), PART).alias("dst")), 2 * n, "src", "dst").distinct()


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer -> part, rated 1 to 5 by the summed quantity."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    total = lines.groupBy("o_custkey", "l_partkey").agg(F.sum("l_quantity").cast("bigint").alias("q"))
    return total.select(vertex("o_custkey", CUSTOMER).alias("src"), vertex("l_partkey", PART).alias("dst"), (1 + F.pmod(F.col("q"), F.lit(5))).cast("double").alias("rating"))


def user_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User -> event type with counts; a type's key is taken from its md5."""
    kind = F.conv(F.substring(F.md5("event_type"), 1, 8), 16, 10).cast("bigint")
    rows = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("weight"))
    return rows.select(vertex("user_id", USER).alias("src"), vertex(kind, EVENT).alias("dst"), "weight")
