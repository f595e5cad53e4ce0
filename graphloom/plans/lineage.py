"""Cutting the lineage of iterative plans through the shared folder, so that lost executors cost a re-read only."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Scratch tables that are not yet deleted, by application.
_scratch: dict[str, set[str]] = {}

#: Spark's setting to delete the shuffle files of a query as soon as it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where none is configured and all is one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all machines of {master} share")
        found = tempfile.mkdtemp(prefix="graphloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and read back from reliable storage, in the same partitions."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextlib.contextmanager
def _set(spark: SparkSession, settings: dict[str, str]):
    """Queries run inside have these settings of the session, which are put back after."""
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def _shuffles_freed(spark: SparkSession, settings: dict[str, str] | None = None):
    """Queries run inside leave no shuffle files behind: their result is a table, which nothing computes again."""
    return _set(spark, {_CLEANUP: "true"} | (settings or {}))


def stored(df: DataFrame, label: str, by: str | None = None, settings: dict[str, str] | None = None, **options: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back: compact, and read by columns.

    It has a file for each task that made it: input splits, or shuffle partitions as adaptive execution joined them by size. The
    table is deleted when the session's Python process ends, or before by ``forget``. The shuffle files behind it go once it is
    written. With ``by``, files are apart by that column, so that ``forget`` can delete the rows of one value. ``settings`` hold while it is written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tables/{label}-{uuid.uuid4().hex}"
    with _shuffles_freed(spark, settings):
        df.write.options(**options).parquet(path, partitionBy=by)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    _scratch.setdefault(spark.sparkContext.applicationId, set()).add(path)
    return out


def forget(*frames: DataFrame, part: str = "") -> None:
    """Deletes tables that ``stored`` wrote, once nothing reads them any more, or one part (column=value) of those written by a column."""
    for df in frames:
        path = getattr(df, "_stored_at", None)
        if path:
            delete(df.sparkSession, f"{path}/{part}" if part else path)


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder on whatever file system it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    _scratch.get(spark.sparkContext.applicationId, set()).discard(path)


def sweep(spark: SparkSession) -> None:
    """Deletes all scratch tables of this application that are left; results that still read them can then not be computed again."""
    for path in list(_scratch.get(spark.sparkContext.applicationId, ())):
        delete(spark, path)


def _sweep_at_exit() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None:
        with contextlib.suppress(Exception):  # the session may be closing; what is left is scratch only
            sweep(spark)


atexit.register(_sweep_at_exit)


def bucketed(df: DataFrame, key: str, n: int | None = None) -> DataFrame:
    """``df`` written once in ``n`` buckets of ``key``, or as many as there are shuffle partitions: joins and aggregates by the key read it
    in place, in every round of an iteration, without another exchange. The catalog keeps no entry of it; the files are scratch."""
    spark = df.sparkSession
    name = f"loom_{uuid.uuid4().hex}"
    n = n or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = f"{shared_dir(spark).rstrip('/')}/tables/{name}"
    placed = df.repartition(n, key)
    with _shuffles_freed(spark):
        placed.write.format("parquet").bucketBy(n, key).sortBy(key).option("path", path).saveAsTable(name)
    out = spark.table(name)
    out.schema  # resolved now: the plan keeps what it needs of the catalog's entry
    spark.sql(f"DROP TABLE {name}")
    out._stored_at = path
    _scratch.setdefault(spark.sparkContext.applicationId, set()).add(path)
    return out


#: Setting by which tables dealt alike by some of a join's keys are joined as they lie.
IN_PLACE = {"spark.sql.requireAllClusterKeysForCoPartition": "false"}

#: Rows that a task of a shuffle gets at most, about, where their number is known.
TASK_ROWS = 1_000_000


def parts(spark: SparkSession, rows: int, each: int = TASK_ROWS) -> int:
    """Partitions for so many rows: as many as a shuffle has, or more, so that none gets more than about ``each``."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // each))


def dealt(df: DataFrame, rows: int, *keys: str, each: int = TASK_ROWS) -> DataFrame:
    """``df``, of about ``rows`` rows, dealt by ``keys`` to as many partitions as keep tasks small; as it is where a shuffle has enough of them."""
    n = parts(df.sparkSession, rows, each)
    return df.repartition(n, *keys) if n > parts(df.sparkSession, 0) else df


def small_side(df: DataFrame, max_rows: int = 200_000) -> DataFrame:
    """``df`` marked for broadcast if it was checked to have at most ``max_rows`` rows, else as it is (a shuffled join)."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
