"""Helpers that several operators of this subpackage share: staged tables and reading."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, set here only in local mode and where it is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        used = spark.sparkContext._jsc.sc().getCheckpointDir()
        if used.isEmpty() and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="pagewarden-") if used.isEmpty() else used.get()
        spark.conf.set("spark.checkpoint.dir", path)
    return path


#: Rows of an Arrow batch while a table is staged: batches of texts and sets stay at a few MB on either side.
BATCH_ROWS = 1_000


@contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> Iterator[None]:
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(name)
    spark.conf.set(name, min(int(was), rows) if int(was) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(name, was)


def staged(df: DataFrame, name: str, codec: str | None = None, rows: int = BATCH_ROWS) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back.

    The table cuts the lineage, survives lost executors and keeps a Python stage from running once per use.
    rows: of an Arrow batch while it is written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _STAGED.append(path)
    with small_batches(spark, rows):
        df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


#: What this process has staged and not released yet, in order.
_STAGED: list[str] = []


def staged_so_far() -> int:
    return len(_STAGED)


def release(spark: SparkSession, since: int = 0, keep: int = 0) -> int:
    """Deletes what this process has staged since a mark of `staged_so_far`, but the last `keep` tables.

    For when nothing that is still to run reads them; other jobs of the process keep what they staged before the mark.
    """
    gone = _STAGED[since : max(since, len(_STAGED) - keep)]
    del _STAGED[since : since + len(gone)]
    for x in gone:
        path = spark._jvm.org.apache.hadoop.fs.Path(x)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return len(gone)


def row_key(doc_id: Column, text: Column) -> Column:
    """64 bits that tell rows apart; a row repeated as a whole has the key of its twin, and so the same result."""
    return F.xxhash64(F.coalesce(doc_id.cast("string"), F.lit("\x00null")), F.coalesce(text, F.lit("")))


def row_keys(doc_id: Column, text: Column) -> tuple[Column, Column]:
    """The same in 128 bits, as columns key and key2: two hashes of unlike seeds, for joins of rows with what was found in them."""
    return row_key(doc_id, text).alias("key"), F.xxhash64(F.lit(1), F.coalesce(doc_id.cast("string"), F.lit("\x00null")), F.coalesce(text, F.lit(""))).alias("key2")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs_of(df: DataFrame, *extra: str) -> DataFrame:
    """doc_id as long and text as string, whatever other columns the table has."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *extra)
