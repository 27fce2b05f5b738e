"""Lab and field vitals, and search and traffic summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import finite


def lab_vitals(runs: DataFrame) -> DataFrame:
    """Medians of each metric over a page's runs; NaN and infinities are dropped, no value gives null."""
    return runs.groupBy("site", "url").agg(
        F.median(finite(F.col("lcp_ms"))).alias("lcp_ms"), F.median(finite(F.col("cls_unitless"))).alias("cls_unitless"), F.median(finite(F.col("tbt_ms"))).alias("tbt_ms"),
        F.count(F.lit(1)).cast("int").alias("runs_completed"),
    )


def _number(v: Column, path: str) -> Column:
    """A finite number at path, or null: a numeric string is none."""
    at = F.try_variant_get(v, path, "variant")
    kind = F.schema_of_variant(at)
    return F.when(kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), finite(F.try_variant_get(v, path, "double")))


def field_vitals(payloads: DataFrame) -> DataFrame:
    """Rows with a payload to the field metrics, beside their other columns; a payload without metrics has no row."""
    v = payloads.withColumn("v", F.try_parse_json("payload"))
    v = v.filter(F.schema_of_variant(F.try_variant_get("v", "$.loadingExperience.metrics", "variant")).startswith("OBJECT"))
    p = lambda m: f"$.loadingExperience.metrics.{m}.percentile"
    return v.select(
        *[c for c in payloads.columns if c != "payload"], _number(F.col("v"), p("LARGEST_CONTENTFUL_PAINT_MS")).alias("field_lcp_ms"), (_number(F.col("v"), p("CUMULATIVE_LAYOUT_SHIFT_SCORE")) / 100).alias("field_cls"),
        _number(F.col("v"), p("INTERACTION_TO_NEXT_PAINT")).alias("field_inp_ms"),
    )


def attach_vitals(pages: DataFrame, lab: DataFrame | None = None, field: DataFrame | None = None) -> DataFrame:
    """Pages of depth 0 get their vitals; others, and pages without any, have nulls. Field values never replace lab values."""
    out = pages
    entry = F.col("depth") == 0
    if lab is not None:
        cols = ["lcp_ms", "cls_unitless", "tbt_ms", "runs_completed"]
        out = out.join(lab.select("site", "url", F.struct(*cols).alias("__lab")), ["site", "url"], "left")
        out = out.select("*", *[F.when(entry, F.col(f"__lab.{c}")).alias(c) for c in cols]).drop("__lab")
    if field is not None:
        cols = ["field_lcp_ms", "field_cls", "field_inp_ms"]
        out = out.join(field.select("site", "url", F.struct(*cols).alias("__field")), ["site", "url"], "left")
        out = out.select("*", *[F.when(entry, F.col(f"__field.{c}")).alias(c) for c in cols]).drop("__field")
    return out


def _lookback(df: DataFrame, as_of: str, days: int) -> DataFrame:
    return df.filter(F.col("date").between(F.date_sub(F.lit(as_of).cast("date"), days), F.lit(as_of).cast("date")))


def search_summary(daily: DataFrame, as_of: str, days: int = 28) -> DataFrame:
    """Clicks, impressions and impression-weighted position over days + 1 dates; nothing found is 0."""
    d = _lookback(daily, as_of, days)
    position = F.sum(F.col("position") * F.col("impressions")) / F.nullif(F.sum("impressions"), F.lit(0))
    return d.agg(F.coalesce(F.sum("clicks"), F.lit(0)).alias("clicks"), F.coalesce(F.sum("impressions"), F.lit(0)).alias("impressions"), F.coalesce(position, F.lit(0.0)).alias("position"))


def traffic_summary(daily: DataFrame, as_of: str, days: int = 28) -> DataFrame:
    """Sessions and active users; values arrive as text, what is no number counts 0."""
    d = _lookback(daily, as_of, days)
    total = lambda c: F.coalesce(F.sum(F.coalesce(F.col(c).try_cast("double"), F.lit(0.0))), F.lit(0.0)).alias(c)
    return d.agg(total("sessions"), total("active_users"))


def search_metrics(payloads: DataFrame) -> DataFrame:
    """(property_scope, payload) to the first row's clicks, impressions and position; else 0."""
    v = payloads.withColumn("v", F.try_parse_json("payload"))
    one = lambda k: F.coalesce(_number(F.col("v"), f"$.rows[0].{k}"), F.lit(0.0)).alias(k)
    return v.select("property_scope", one("clicks"), one("impressions"), one("position"))


def traffic_metrics(payloads: DataFrame) -> DataFrame:
    """(property_id, payload) to the first row's two values, given bare or as objects with a value; else 0."""
    v = payloads.withColumn("v", F.try_parse_json("payload"))

    def one(i: int, name: str) -> Column:
        at = f"$.rows[0].metricValues[{i}]"
        text = F.coalesce(F.try_variant_get("v", f"{at}.value", "string"), F.when(~F.schema_of_variant(F.try_variant_get("v", at, "variant")).startswith("OBJECT"), F.try_variant_get("v", at, "string")))
        return F.coalesce(finite(text.try_cast("double")), F.lit(0.0)).alias(name)

    return v.select("property_id", one(0, "sessions"), one(1, "active_users"))


def stream_windows(events: DataFrame, width: str = "1 day", slide: str | None = None) -> DataFrame:
    """Approximate medians of the vitals in time windows; batch and streaming."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.groupBy(w.alias("w"), "url").agg(F.percentile_approx("lcp_ms", 0.5).alias("lcp_ms"), F.count(F.lit(1)).alias("runs")).select(F.col("w.start").alias("window_start"), "url", "lcp_ms", "runs")
