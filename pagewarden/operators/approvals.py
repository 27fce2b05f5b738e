"""Decisions, applications, rollbacks and acknowledgements as changes of stored tables: each a named merge.

The rules are those of the column operators in `remediation` and `findings`; here their results stay. A merge of a name
that is there already changes nothing, and rows that a rule does not let change keep their partitions as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import versioned
from . import findings as fi
from . import remediation

KEY = ["finding_key"]


def store_plans(plans: DataFrame, path: str, partitions: int = versioned.PARTITIONS) -> None:
    """Proposals with empty application columns; of a key that repeats, the smallest row."""
    rest = [c for c in plans.columns if c != "finding_key"]
    one = plans.filter("finding_key is not null").groupBy("finding_key").agg(F.min(F.struct(*rest)).alias("r")).select("finding_key", "r.*")
    full = one.select("*", F.lit(None).cast("timestamp").alias("applied_at"), F.lit(None).cast("string").alias("backup"), F.lit("open").alias("finding_status"))
    versioned.create(full, path, KEY, partitions)


def decide(spark: SparkSession, path: str, decisions: DataFrame, name: str) -> int:
    """decisions: finding_key, decision. Only pending proposals take one. The version after it."""
    return versioned.merge(spark, path, decisions, lambda old, new: remediation.decide(old, new).drop("changed"), name).version


def apply(spark: SparkSession, path: str, outcomes: DataFrame, name: str) -> int:
    """outcomes: finding_key, applied_at, backup. Only auto and approved proposals take one."""
    return versioned.merge(spark, path, outcomes, remediation.mark_applied, name).version


def rollback(spark: SparkSession, path: str, keys: DataFrame, name: str) -> int:
    """keys: finding_key. Only applied proposals are taken back."""
    return versioned.merge(spark, path, keys, remediation.rollback, name).version


def acknowledge(spark: SparkSession, path: str, keys: DataFrame, name: str) -> int:
    """keys: site, finding_key of a stored table of findings under (site, finding_key, id)."""
    ids = versioned.read(spark, path).join(keys.select("site", "finding_key").distinct(), ["site", "finding_key"], "left_semi").select("site", "finding_key", "id")
    return versioned.merge(spark, path, ids, fi.acknowledge, name).version


def update_requests(spark: SparkSession, path: str, states: DataFrame, name: str) -> int:
    """states: id, new_state of a stored table of change requests under id."""
    return versioned.merge(spark, path, states, remediation.update_requests, name).version


def close_runs(spark: SparkSession, path: str, finished: DataFrame, name: str) -> int:
    """finished: id, finished_at of a stored table of runs under id. A run that is closed stays as it is."""
    from ..sources.tables import close_runs as closed

    return versioned.merge(spark, path, finished, closed, name).version
