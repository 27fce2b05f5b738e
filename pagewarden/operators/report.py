"""Reports of a site and run, as JSON or Markdown, in parts: a head, one part for each page, a tail.

The parts of a report in the order of (kind, ord), joined by line breaks, are its text. A part is one row, so no site is gathered into a row or
a task; `write_reports` deals the parts out by range, and a site's files, in order of their names, are its report.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fixed, table_cell
from .rules import severity_rank

_V = ("rule_id", "rule_version", "category", "severity", "current_value", "recommended_value")
HEAD, PAGE, TAIL = 0, 1, 2
LAB_NOTE = "medians of lab runs; visitors may see other values"
FIELD_NOTE = "values of real visits over 28 days"


def report_pages(pages: DataFrame, findings: DataFrame, by: tuple[str, ...] = ("site", "run_id", "url")) -> DataFrame:
    """A row for each page: site, run_id, ord, url, status_code, violations in order of impact, lab and field vitals.

    pages: site, run_id, url, ord, status_code, lcp_ms, cls_unitless, tbt_ms and the field vitals. A page has the findings of the
    same `by`: of its URL, however often that was fetched, unless a column beside the URL tells its rows apart.
    """
    v = F.struct(severity_rank(F.col("severity")).alias("rank"), F.col("rule_ord"), F.struct(*_V).alias("v"))
    by_page = findings.groupBy(*by).agg(F.array_sort(F.collect_list(v)).alias("vs"))
    none = F.array().cast("array<struct<" + ",".join(f"{c}:{'int' if c == 'rule_version' else 'string'}" for c in _V) + ">>")
    lab, field = ("lcp_ms", "cls_unitless", "tbt_ms"), ("field_lcp_ms", "field_cls", "field_inp_ms")
    return pages.join(by_page, list(by), "left").select(
        "site", "run_id", "ord", "url", "status_code", F.coalesce(F.transform("vs", lambda x: x["v"]), none).alias("violations"),
        F.when(F.coalesce(*lab).isNotNull(), F.struct(*lab, F.lit(True).alias("is_lab_data"), F.lit(LAB_NOTE).alias("note"))).alias("cwv"),
        F.when(F.coalesce(*field).isNotNull(), F.struct(*field, F.lit(True).alias("is_field_data"), F.lit(FIELD_NOTE).alias("note"))).alias("field_data"),
    )


def robots_page(violations: DataFrame, states: DataFrame) -> DataFrame:
    """The page that stands first in a report where the crawler policy is known: robots.txt itself, without vitals.

    violations: those of the policy rule; states: site, state. It counts as a page, and the policy is its finding.
    """
    none = [F.lit(None).cast("double").alias(c) for c in ("lcp_ms", "cls_unitless", "tbt_ms", "field_lcp_ms", "field_cls", "field_inp_ms")]
    status = F.when(F.col("state") == "found", 200).otherwise(404)
    return violations.join(states.select("site", "state"), "site").select("site", "run_id", "url", F.lit(-1).cast("long").alias("ord"), status.alias("status_code"), *none)


def report_heads(summary: DataFrame, search: DataFrame | None = None, traffic: DataFrame | None = None) -> DataFrame:
    """Counts and label of each site and run, with what is known of searches and visits.

    search: site, clicks, impressions, position, error; traffic: site, sessions, active_users, error. A site without a
    row has no such section; a row with an error has the error alone.
    """
    out = summary
    for name, df, cols in (("search", search, ("clicks", "impressions", "position")), ("traffic", traffic, ("sessions", "active_users"))):
        if df is None:
            kinds = "struct<clicks:bigint,impressions:bigint,position:double>" if name == "search" else "struct<sessions:double,active_users:double>"
            out = out.withColumn(name, F.lit(None).cast(kinds)).withColumn(f"{name}_error", F.lit(None).cast("string"))
        else:
            d = df.select("site", F.when(F.col("error").isNull(), F.struct(*cols)).alias(name), F.col("error").alias(f"{name}_error"))
            out = out.join(d, "site", "left")
    return out


def _parts(kind: int, df: DataFrame, ord_: Column, text: Column) -> DataFrame:
    return df.select("site", "run_id", F.lit(kind).alias("kind"), ord_.cast("long").alias("ord"), text.alias("text"))


def to_json_report(pages: DataFrame, heads: DataFrame, generated_at: str) -> DataFrame:
    """(site, run_id, kind, ord, text): nested JSON; absent sections are null fields."""
    js = lambda c: F.to_json(c, {"ignoreNullFields": "false"})
    by = F.struct("critical", "high", "medium", "low")
    head = F.struct(
        F.col("site").alias("target"), F.lit(generated_at).alias("generated_at"), F.col("label").alias("overall_label"),
        F.struct(F.col("pages").alias("total_pages"), F.col("total").alias("total_violations"), by.alias("by_severity")).alias("summary"), "search", "search_error", "traffic", "traffic_error",
    )
    first = pages.groupBy("site", "run_id").agg(F.min("ord").alias("first"))
    comma = F.when(F.col("ord") == F.col("first"), "").otherwise(",")
    page = js(F.struct("url", "status_code", "violations", "cwv", "field_data"))
    top = _parts(HEAD, heads, F.lit(0), F.concat(F.regexp_replace(js(head), r"\}$", ""), F.lit(',"pages":[')))
    body = _parts(PAGE, pages.join(first, ["site", "run_id"]), F.col("ord"), F.concat(comma, page))
    return top.unionByName(body).unionByName(_parts(TAIL, heads, F.lit(0), F.lit("]}")))


def _measure(name: str, value: Column, unit: str = "") -> Column:
    return F.concat(F.lit(f"{name} "), F.coalesce(F.concat(value, F.lit(unit)), F.lit("unknown")))


def _ms(c: Column) -> Column:
    return F.round(c).cast("long").cast("string")


def to_markdown(pages: DataFrame, heads: DataFrame, generated_at: str) -> DataFrame:
    """(site, run_id, kind, ord, text): Markdown with one table of counts, a paragraph for each source of numbers, a list of findings for each page."""
    cell = lambda *c: F.concat(F.lit("| "), F.concat_ws(" | ", *[x.cast("string") for x in c]), F.lit(" |"))
    section = lambda name, ok, text: F.when(F.col(f"{name}_error").isNotNull(), F.concat(F.lit(f"{ok} could not be read: "), F.col(f"{name}_error"))).when(F.col(name).isNotNull(), F.concat(F.lit(f"{ok} (29 days): "), text))
    search = F.concat_ws(", ", _measure("clicks", F.col("search.clicks").cast("string")), _measure("impressions", F.col("search.impressions").cast("string")), _measure("mean position", fixed(F.col("search.position"), 1)))
    traffic = F.concat_ws(", ", _measure("sessions", _ms(F.col("traffic.sessions"))), _measure("active users", _ms(F.col("traffic.active_users"))))
    top = F.concat_ws(
        "\n\n", F.concat(F.lit("# "), F.col("site")),
        F.concat_ws("\n", F.lit("| state | pages | critical | high | medium | low | of |"), F.lit("|---|---|---|---|---|---|---|"), cell(F.col("label"), F.col("pages"), *map(F.col, ("critical", "high", "medium", "low")), F.lit(generated_at))),
        F.when(F.col("pages") == 0, F.lit("*No page could be looked at, so this says nothing about the site. Is the address right?*")),
        section("search", "Searches", search), section("traffic", "Visits", traffic),
    )
    lab = F.when(F.col("cwv").isNotNull(), F.concat(F.lit(f"Lab ({LAB_NOTE}): "), F.concat_ws(", ", _measure("LCP", _ms(F.col("cwv.lcp_ms")), " ms"), _measure("CLS", fixed(F.col("cwv.cls_unitless"), 3)), _measure("TBT", _ms(F.col("cwv.tbt_ms")), " ms"))))
    field = F.when(F.col("field_data").isNotNull(), F.concat(F.lit(f"Field ({FIELD_NOTE}): "), F.concat_ws(", ", _measure("LCP", _ms(F.col("field_data.field_lcp_ms")), " ms"), _measure("CLS", fixed(F.col("field_data.field_cls"), 3)), _measure("INP", _ms(F.col("field_data.field_inp_ms")), " ms"))))
    line = lambda v: F.concat(F.lit("* "), v["severity"], F.lit(" `"), v["rule_id"], F.lit("`, "), v["category"], F.lit(": "), table_cell(v["current_value"]), F.lit(" -> "), table_cell(v["recommended_value"]))
    found = F.when(F.size("violations") == 0, F.lit("Nothing found.")).otherwise(F.array_join(F.transform("violations", line), "\n"))
    page = F.concat(F.lit("\n"), F.concat_ws("\n\n", F.concat(F.lit("## "), F.col("url"), F.lit(" ("), F.col("status_code").cast("string"), F.lit(")")), lab, field, found))
    end = F.lit("\nThis run only read pages.")
    return _parts(HEAD, heads, F.lit(0), top).unionByName(_parts(PAGE, pages, F.col("ord"), page)).unionByName(_parts(TAIL, heads, F.lit(0), end))


def write_reports(parts: DataFrame, path: str, files: int = 200) -> None:
    """Text files in a folder for each site and run. A large site has several, whose names are in its report's order."""
    keys = ["site", "run_id", "kind", "ord"]
    dealt = parts.repartitionByRange(files, *keys).sortWithinPartitions(*keys)
    dealt.select("site", "run_id", "text").write.mode("overwrite").partitionBy("site", "run_id").text(path)
