"""Cutting the lineage of iterative jobs, and staging of tables, in a folder that executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; in local mode, where it is unset, a folder of this machine."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        used = spark.sparkContext._jsc.sc().getCheckpointDir()
        if used.isEmpty() and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="pagewarden-") if used.isEmpty() else used.get()
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """df written as a table in the shared folder and read again: what follows starts there, and so does a recovery."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    _CUT.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: What this process has staged and not released yet.
_CUT: list[str] = []


def release(spark: SparkSession) -> int:
    """Deletes all that `cut` has staged in this process, once its results are written; the number of tables."""
    n = 0
    while _CUT:
        path = spark._jvm.org.apache.hadoop.fs.Path(_CUT.pop())
        n += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return n


def ranked(df: DataFrame, by: list[str], order: list[Column], name: str = "place") -> DataFrame:
    """df with each row's place, from 1, in its group by that order; a group of any size is spread over tasks.

    Rows are dealt by ranges of group and order and staged; a row's place is that in its range, plus the sizes of the
    group's ranges before. Rows that are equal in the order lie in one range.
    """
    parted = cut(df.repartitionByRange(*[F.col(c) for c in by], *order).withColumn("__range", F.spark_partition_id()), "ranges")
    sizes = parted.groupBy(*by, "__range").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(*[F.col(c).alias(f"__{c}") for c in by], F.col("__range").alias("__r"), F.coalesce(before, F.lit(0)).alias("__before"))
    own = parted.withColumn("__at", F.row_number().over(Window.partitionBy("__range", *by).orderBy(*order)))
    same = F.col("__range") == F.col("__r")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return own.join(starts, same).select(*df.columns, (F.col("__at") + F.col("__before")).alias(name))
