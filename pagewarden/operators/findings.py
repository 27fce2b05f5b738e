"""Findings under stable keys, their summaries, baselines and regressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import finding_key
from ..sources.staging import ranked
from .rules import severity_rank


def to_findings(violations: DataFrame) -> DataFrame:
    """Violations with finding_key and status open. A violation on a page without a parseable URL has a null key."""
    return violations.withColumn("finding_key", finding_key(F.col("url"), F.col("rule_id"), F.col("rule_version"))).withColumn("status", F.lit("open"))


def severity_summary(findings: DataFrame, pages: DataFrame) -> DataFrame:
    """Counts by severity, pages and label of each site and run; sites without findings or pages are in it too."""
    by = findings.groupBy("site", "run_id").agg(
        *(F.count_if(F.col("severity") == s).alias(s) for s in ("critical", "high", "medium", "low")), F.count(F.lit(1)).alias("total")
    )
    n = pages.groupBy("site", "run_id").agg(F.count("url").alias("pages"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    j = n.join(by, ["site", "run_id"], "full")
    label = F.when(F.col("critical") > 0, "danger").when(F.col("high") > 0, "caution").otherwise("good")
    return j.select("site", "run_id", *map(zero, ("critical", "high", "medium", "low", "total", "pages")), label.alias("label"), (F.coalesce("pages", F.lit(0)) == 0).alias("no_pages"))


def impact_order(findings: DataFrame) -> DataFrame:
    """place: position within a page by severity, equal ones in registry order."""
    order = Window.partitionBy("site", "run_id", "url").orderBy(severity_rank(F.col("severity")), "rule_ord")
    return findings.withColumn("place", F.row_number().over(order))


def latest_by(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of the largest `order` for each key."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("m")).select(*keys, "m.*")


def latest_finished_runs(runs: DataFrame) -> DataFrame:
    return latest_by(runs.filter("finished_at is not null"), ["project_id"], "id")


def snapshot(findings: DataFrame) -> DataFrame:
    """A baseline's entries: for each key the category, severity and status of its last row; occurrences counts rows."""
    return findings.groupBy("site", "finding_key").agg(F.max_by(F.struct("category", "severity", "status"), "id").alias("m"), F.count(F.lit(1)).alias("occurrences")).select("site", "finding_key", "m.*", "occurrences")


def classify_regressions(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """Keys that the baseline lacks: intended if acknowledged, else regression. One row for each key, the last id's."""
    one = current.groupBy("site", "finding_key").agg(F.max_by("status", "id").alias("status"), F.count(F.lit(1)).alias("occurrences"))
    new = one.join(baseline.select("site", "finding_key"), ["site", "finding_key"], "left_anti")
    return new.select("site", "finding_key", F.when(F.col("status") == "acknowledged", "intended").otherwise("regression").alias("kind"), "occurrences")


def resolved(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """Keys of the baseline that are gone."""
    return baseline.select("site", "finding_key").distinct().join(current.select("site", "finding_key"), ["site", "finding_key"], "left_anti")


def decorate(regressions: DataFrame, findings: DataFrame) -> DataFrame:
    """Rule, page and severity of each key, from the last finding that has it; ordered critical to low by `place`."""
    last = findings.groupBy("site", "finding_key").agg(F.max_by(F.struct("rule_id", "url", "severity", "rule_ord"), "id").alias("f"))
    j = regressions.join(last, ["site", "finding_key"]).select("site", "finding_key", "kind", "f.*")
    return ranked(j.withColumn("__severity", severity_rank(F.col("severity"))), ["site"], [F.col("__severity"), F.col("rule_ord"), F.col("url")]).drop("__severity")


def acknowledge(findings: DataFrame, keys: DataFrame) -> DataFrame:
    """Findings of the given keys become acknowledged; the next baseline carries that."""
    k = keys.select("site", "finding_key").distinct().withColumn("__ack", F.lit(True))
    j = findings.join(k, ["site", "finding_key"], "left")
    return j.withColumn("status", F.when(F.col("__ack"), "acknowledged").otherwise(F.col("status"))).drop("__ack")
