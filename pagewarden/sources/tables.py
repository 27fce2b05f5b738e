"""Scans of the input tables and appends of the output tables. Schemas are explicit; tables are partitioned by site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import excerpt, has, one_of
from ..operators.robots import robots_state
from ..operators.rules import CATEGORIES, SEVERITIES

SCHEMAS = {
    "crawl_snapshot": "site string, run_id string, url string, depth int, status_code int, html string, rendered_html string, final_url string, redirect_chain array<string>",
    "robots_doc": "site string, status_code int, body string",
    "sitemap_doc": "site string, sitemap_url string, status_code int, body string",
    "lab_runs": "site string, url string, run int, lcp_ms double, cls_unitless double, tbt_ms double",
    "field_payload": "site string, url string, payload string",
    "search_daily": "date date, clicks long, impressions long, position double",
    "traffic_daily": "date date, sessions string, active_users string",
    "regression": "site string, run_id string, finding_key string, kind string, at timestamp",
    "remediation": "site string, run_id string, finding_key string, rule_id string, fix_type string, risk_level string, marker string, approval_status string, at timestamp",
    "change_request": "site string, bucket string, branch_name string, state string, at timestamp",
    "project": "id long, target string, created_at timestamp",
    "audit_run": "id long, project_id long, started_at timestamp, finished_at timestamp, score double, render_source string",
}


def scan(spark: SparkSession, path: str, name: str, where: Column | None = None) -> DataFrame:
    """A Parquet table by its schema; `where` on site or run_id prunes partitions and row groups."""
    df = spark.read.schema(SCHEMAS[name]).parquet(f"{path.rstrip('/')}/{name}")
    return df if where is None else df.filter(where)


def robots_docs(docs: DataFrame) -> DataFrame:
    return docs.select("site", "status_code", "body", robots_state(F.col("status_code"), F.col("body")).alias("state"))


def sitemap_docs(docs: DataFrame) -> DataFrame:
    """Documents of any other status than 200 have no rows."""
    return docs.filter("status_code = 200")


def by_key(df: DataFrame, column: str, value) -> DataFrame:
    return df.filter(F.col(column) == value)


def history(regressions: DataFrame) -> DataFrame:
    """Newest first."""
    return regressions.orderBy(F.desc("id"))


def page_records(context: DataFrame, raw: str = "raw") -> DataFrame:
    """What is kept of a page: a digest and 500 characters of its HTML, never the whole."""
    content = F.col(f"{raw}.title").isNotNull() | (F.col(f"{raw}.h1_count") > 0)
    return context.select("site", "run_id", "url", "status_code", F.sha2(F.coalesce("html", F.lit("")), 256).alias("html_sha256"), excerpt(F.coalesce("html", F.lit(""))).alias("html_excerpt"), content.alias("raw_has_content"))


# What the enumerations of the tables allow.
STATUSES = ("open", "acknowledged", "fixed", "reverted")
KINDS = ("regression", "intended")
FIX_TYPES, RISKS, APPROVALS = ("file_edit", "report_only"), ("add_safe", "gated"), ("auto", "pending", "approved", "rejected")
REQUEST_STATES = ("open", "closed", "merged")


def _checked(df: DataFrame, **allowed: tuple[str, ...]) -> DataFrame:
    """df; a value outside of its column's enumeration fails the write."""
    return df.select(*[one_of(F.col(c), list(allowed[c])).alias(c) if c in allowed else F.col(c) for c in df.columns])


def checked_findings(findings: DataFrame) -> DataFrame:
    return _checked(findings, severity=SEVERITIES, category=CATEGORIES, status=STATUSES)


def regression_rows(regressions: DataFrame, run_id: str, at: Column) -> DataFrame:
    return _checked(regressions.select("site", F.lit(run_id).alias("run_id"), "finding_key", "kind", at.alias("at")), kind=KINDS)


def remediation_rows(plans: DataFrame, at: Column) -> DataFrame:
    cols = ("site", "run_id", "finding_key", "rule_id", "fix_type", "risk_level", "marker", "approval_status")
    return _checked(plans.select(*cols, at.alias("at")), fix_type=FIX_TYPES, risk_level=RISKS, approval_status=APPROVALS)


def request_rows(planned: DataFrame, at: Column) -> DataFrame:
    """One open request for each branch of a bucket."""
    return _checked(planned.select("site", "bucket", "branch_name").distinct().select("*", F.lit("open").alias("state"), at.alias("at")), state=REQUEST_STATES)


def append(df: DataFrame, path: str, name: str, by: tuple[str, ...] = ("site",)) -> None:
    """Appends rows, partitioned. Rows of one partition are brought together first, but a large one in several tasks and files."""
    df.hint("rebalance", *by).write.mode("append").partitionBy(*by).parquet(f"{path.rstrip('/')}/{name}")


def overwrite_partitions(df: DataFrame, path: str, name: str, by: tuple[str, ...] = ("site",)) -> None:
    """Replaces the partitions that df has rows for, and no others."""
    df.hint("rebalance", *by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(f"{path.rstrip('/')}/{name}")


def open_runs(projects: DataFrame, started_at: Column, render_source: str) -> DataFrame:
    return projects.select(F.xxhash64("project_id", started_at).alias("id"), "project_id", started_at.alias("started_at"), F.lit(None).cast("timestamp").alias("finished_at"), F.lit(None).cast("double").alias("score"), F.lit(render_source).alias("render_source"))


def close_runs(runs: DataFrame, finished: DataFrame) -> DataFrame:
    """finished: id, finished_at. The score stays null: labels are shown, not scores."""
    f = finished.select("id", F.col("finished_at").alias("__f"))
    return runs.join(f, "id", "left").withColumn("finished_at", F.coalesce("finished_at", "__f")).drop("__f")


def find_or_create_projects(existing: DataFrame, targets: DataFrame, now: Column) -> DataFrame:
    """The latest project of each target; targets without one get a new project."""
    t = targets.select("target").filter(has(F.col("target"))).distinct()
    latest = existing.join(t, "target", "left_semi").groupBy("target").agg(F.max("id").alias("id")).withColumn("created", F.lit(False))
    new = t.join(existing.select("target"), "target", "left_anti").select("target", F.xxhash64("target").alias("id"), F.lit(True).alias("created"))
    return latest.unionByName(new)


BUCKETS = 64


def save_bucketed(df: DataFrame, path: str, table: str, by: tuple[str, ...] = ("site", "url"), buckets: int = BUCKETS) -> DataFrame:
    """df as a table of the session's catalog, stored under path in buckets of the key: joins on the key shuffle nothing.

    Rows are dealt to the buckets before they are written, so each bucket is a file.
    """
    df.repartition(buckets, *by).write.format("parquet").bucketBy(buckets, *by).sortBy(*by).option("path", f"{path.rstrip('/')}/{table}").mode("overwrite").saveAsTable(table)
    return df.sparkSession.table(table)
