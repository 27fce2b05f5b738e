"""The registered queries of the site operators. Each reads the given tables and returns plain columns."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import jsonld, text, urls
from ..operators import findings as fi
from ..operators import approvals, html, linkgraph, remediation, report, robots, rules, sitemap, vitals
from ..sources import tables, versioned
from ..sources.staging import cut, ranked, shared_folder
from ..streaming import streams
from . import fixtures as fx

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def now():
    """A fixed instant. Columns are made when a query runs: there may be no session when this module is imported."""
    return F.lit("2024-02-01 00:00:00").cast("timestamp")


def query(name: str):
    def add(f):
        QUERIES[name] = f
        return f

    return add


def _add(name: str, f: Callable[[SparkSession, str], DataFrame]) -> None:
    QUERIES[name] = f


#: What tells rows of pages apart: a URL may have been fetched more than once.
BY_PAGE = ("site", "run_id", "url", "page_id")


def violations(s: SparkSession, d: str, shift: int = 0, lab: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    return rules.evaluate_rules(fx.context(s, d, shift, lab), keep=keep)


def findings(s: SparkSession, d: str, shift: int = 0) -> DataFrame:
    """Findings with ids; every fifth page's findings of run B are acknowledged."""
    v = rules.evaluate_rules(fx.context(s, d, shift, lab=False), keep=("page_id",))
    f = fi.to_findings(v).withColumn("id", F.col("page_id") * 1000 + F.col("rule_ord"))
    return f.withColumn("status", F.when(F.lit(shift == 1) & (F.col("page_id") % 5 == 0), "acknowledged").otherwise("open"))


def flagship(s: SparkSession, d: str) -> DataFrame:
    """Severity counts and label of every site, from raw pages to the summary."""
    c = fx.context(s, d)
    return fi.severity_summary(fi.to_findings(rules.evaluate_rules(c)), c).orderBy("site")


# Sources
_add("src1_pages", lambda s, d: fx.crawl_snapshot(s, d).filter("status_code = 200").select("site", "url", "depth", "status_code"))

@query("src1b_snapshot_scan")
def _snapshot_scan(s, d):
    """Snapshots stored by site and run; the scan reads run A's partitions and two columns."""
    path = f"{shared_folder(s)}/{uuid.uuid4().hex}"
    for shift in (0, 1):
        tables.append(fx.crawl_snapshot(s, d, shift).drop("page_id", "k"), path, "crawl_snapshot", ("run_id",))
    return tables.scan(s, path, "crawl_snapshot", F.col("run_id") == "A").select("url", "status_code")


_add("src2_robots", lambda s, d: tables.robots_docs(fx.robots_doc(s, d)).select("site", "status_code", "state"))
_add("src3_sitemaps", lambda s, d: tables.sitemap_docs(fx.sitemap_doc(s, d)).select("site", "sitemap_url", F.length("body").cast("long").alias("body_length")))
_add("src4_lab_runs", lambda s, d: fx.lab_runs(s, d).groupBy("site", "url", "run").agg(F.count("lcp_ms").alias("measured")))
_add("src5_field_payloads", lambda s, d: fx.field_payloads(s, d).select("url", "event_id", F.try_parse_json("payload").isNotNull().alias("parses")))
_add("src6_metric_scans", lambda s, d: fx.search_daily(s, d).join(fx.traffic_daily(s, d), "date").select("date", "clicks", "impressions", "sessions", "active_users"))
_add("src7_findings_by_run", lambda s, d: tables.by_key(findings(s, d), "run_id", "A").groupBy("rule_id").agg(F.count(F.lit(1)).alias("n")))

# Sinks: what is written, as rows
_add("snk1_page_records", lambda s, d: written(s, tables.page_records(extract(s, d)), "page_records").select("url", "status_code", F.length("html_excerpt").cast("long").alias("excerpt_length"), "raw_has_content"))


def written(s: SparkSession, df: DataFrame, name: str, by: tuple[str, ...] = ("site",)) -> DataFrame:
    """df appended to a new table in the shared folder in two halves, and read back."""
    path = f"{shared_folder(s)}/{uuid.uuid4().hex}"
    half = F.pmod(F.xxhash64(*[c for c in df.columns if c != "at"]), F.lit(2))
    for k in (0, 1):
        tables.append(df.filter(half == k), path, name, by)
    return s.read.schema(df.schema).parquet(f"{path}/{name}")


_add("snk1b_page_digests", lambda s, d: written(s, tables.page_records(html.extract_signals(fx.pages(s, d).select("site", F.lit("A").alias("run_id"), "url", F.lit(200).alias("status_code"), "html", F.col("html").alias("h")), {"h": "raw"})), "page_digests").select("url", "html_sha256", "html_excerpt"))
_add("snk2_findings", lambda s, d: written(s, tables.checked_findings(findings(s, d)).drop("page_id", "k"), "findings", ("run_id",)).select("finding_key", "rule_id", "status", "id"))
_add("snk5_baseline_rows", lambda s, d: written(s, fi.snapshot(findings(s, d)), "baseline").select("site", "finding_key", "category", "severity", "status"))
_add("snk5b_regression_rows", lambda s, d: written(s, tables.regression_rows(fi.classify_regressions(findings(s, d, 1), fi.snapshot(findings(s, d))), "B", now()), "regressions", ("run_id",)).select("site", "run_id", "finding_key", "kind"))
_add("snk5c_remediation_rows", lambda s, d: written(s, tables.remediation_rows(plans(s, d).filter("marker is not null"), now()), "remediations").select("site", "rule_id", "finding_key", "risk_level", "approval_status"))
_add("snk5d_request_rows", lambda s, d: written(s, tables.request_rows(planned(s, d), now()), "change_requests").select("site", "bucket", "branch_name", "state"))


def extract(s: SparkSession, d: str) -> DataFrame:
    c = fx.crawl_snapshot(s, d)
    return html.extract_signals(c.withColumn("h", F.col("html")), {"h": "raw"})


@query("snk6_projects")
def _projects(s, d):
    old = fx.sites(s, d).filter("rank % 2 = 0").select(F.col("rank").cast("long").alias("id"), F.col("site").alias("target"))
    old = old.unionByName(old.filter("id % 4 = 0").select((F.col("id") + 1000).alias("id"), "target"))
    out = tables.find_or_create_projects(old, fx.sites(s, d).select(F.col("site").alias("target")), now())
    return out.select("target", F.when(~F.col("created"), F.col("id")).alias("id"), "created")


def runs(s: SparkSession, d: str) -> DataFrame:
    """Three runs for each site; the last one is unfinished where rank is odd."""
    r = fx.sites(s, d).select("rank", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("i"))
    done = (F.col("i") < 2) | (F.col("rank") % 2 == 0)
    return r.select((F.col("rank") * 10 + F.col("i")).cast("long").alias("id"), F.col("rank").cast("long").alias("project_id"), F.when(done, F.timestamp_seconds(F.lit(1706745600) + F.col("i") * 60)).alias("finished_at"))


@query("snk7_runs")
def _runs(s, d):
    """Runs are opened and appended, and closed by replacing the partitions of those that end: what is read back."""
    path = f"{shared_folder(s)}/{uuid.uuid4().hex}"
    opened = tables.open_runs(fx.sites(s, d).select(F.col("rank").cast("long").alias("project_id")), F.lit("2024-01-31 00:00:00").cast("timestamp"), "both")
    tables.append(opened, path, "audit_run", ("project_id",))
    ended = tables.scan(s, path, "audit_run", F.col("project_id") % 2 == 0)
    tables.overwrite_partitions(cut(tables.close_runs(ended, ended.select("id", now().alias("finished_at")))), path, "audit_run", ("project_id",))
    stored = tables.scan(s, path, "audit_run").withColumn("run", F.lit(3))
    r = runs(s, d)
    closed = tables.close_runs(r, r.filter("finished_at is null").select("id", now().alias("finished_at")))
    ends = closed.groupBy("project_id").agg(F.count("finished_at").alias("finished"), F.max(F.unix_timestamp("finished_at")).alias("last_at"))
    return ends.join(stored.select("project_id", F.col("finished_at").isNotNull().alias("stored_end"), "render_source"), "project_id")


def reports(s: SparkSession, d: str, by: tuple[str, ...] = ("site", "run_id", "url")) -> tuple[DataFrame, DataFrame]:
    """Pages and heads of each site's report; robots.txt stands first where its state is known. by: as in report_pages."""
    c = cut(fx.context(s, d), "context")
    docs, _ = robots_tables(s, d)
    ai = fi.to_findings(rules.ai_policy_rule(robots.policy_summary(access(s, d)).withColumn("run_id", F.lit("A"))))
    own = fi.to_findings(rules.evaluate_rules(c, keep=("page_id",))).withColumnRenamed("page_id", "ord")
    f = cut(own.unionByName(ai.withColumn("ord", F.lit(-1).cast("long"))), "findings")
    p = vitals.attach_vitals(c.select("site", "run_id", "url", F.col("page_id").alias("ord"), "status_code", "depth", "lcp_ms", "cls_unitless", "tbt_ms"), None, fx.field_by_page(s, d)).drop("depth")
    p = p.unionByName(report.robots_page(ai, docs))
    # A third of the sites has search figures, a third an error, a third neither; traffic has it the other way round.
    sites = fx.sites(s, d)
    told = lambda df, k: sites.filter("rank % 3 < 2").crossJoin(F.broadcast(df)).withColumn("error", F.when(F.col("rank") % 3 == k, "quota used up"))
    search, traffic = told(vitals.search_summary(fx.search_daily(s, d), fx.AS_OF), 1), told(vitals.traffic_summary(fx.traffic_daily(s, d), fx.AS_OF), 0)
    return report.report_pages(p, f, by), report.report_heads(fi.severity_summary(f, p), search, traffic)


_AT = "2024-02-01T00:00:00Z"


@query("snk3_json_report")
def _json_report(s, d):
    """What the parts of the JSON hold when they are parsed again."""
    parts = cut(report.to_json_report(*reports(s, d), _AT), "json-parts")
    head = "overall_label string, summary struct<total_pages:bigint,total_violations:bigint,by_severity:struct<critical:bigint,high:bigint,medium:bigint,low:bigint>>, search struct<clicks:bigint,impressions:bigint,position:double>, search_error string, traffic struct<sessions:double,active_users:double>, traffic_error string, pages array<string>"
    page = "url string, status_code int, violations array<struct<rule_id:string,severity:string,current_value:string>>, cwv struct<lcp_ms:double,cls_unitless:double,tbt_ms:double,is_lab_data:boolean>, field_data struct<field_lcp_ms:double,field_cls:double,field_inp_ms:double,is_field_data:boolean>"
    none = F.lit(None).cast("double")
    h = parts.filter("kind = 0").select("site", "kind", "ord", F.from_json(F.concat("text", F.lit("]}")), head).alias("j"))
    told = F.concat_ws("|", "j.overall_label", "j.summary.total_pages", "j.summary.total_violations", *(f"j.summary.by_severity.{x}" for x in rules.SEVERITIES), "j.search.clicks", "j.search.impressions", "j.search_error", F.col("j.traffic.sessions").cast("long").cast("string"), F.col("j.traffic.active_users").cast("long").cast("string"), "j.traffic_error")
    h = h.select("site", "kind", "ord", told.alias("told"), F.round("j.search.position", 6).alias("n1"), none.alias("n2"), none.alias("n3"), none.alias("n4"), none.alias("n5"), none.alias("n6"))
    p = parts.filter("kind = 1").select("site", "kind", "ord", F.from_json(F.regexp_replace("text", "^,", ""), page).alias("j"))
    found = F.array_join(F.transform("j.violations", lambda v: F.concat(v["rule_id"], F.lit("="), F.coalesce(v["current_value"], F.lit("-")))), ";")
    p = p.select("site", "kind", "ord", F.concat_ws("|", "j.url", "j.status_code", found).alias("told"), *(F.round(f"j.{c}", 6).alias(f"n{i + 1}") for i, c in enumerate(("cwv.lcp_ms", "cwv.cls_unitless", "cwv.tbt_ms", "field_data.field_lcp_ms", "field_data.field_cls", "field_data.field_inp_ms"))))
    return h.unionByName(p)


_add("snk4_markdown", lambda s, d: report.to_markdown(*reports(s, d), _AT).select("site", "kind", "ord", "text"))
_add("agg8_report", lambda s, d: reports(s, d, ("site", "run_id", "url", "ord"))[0].groupBy("site").agg(F.count(F.lit(1)).alias("pages"), F.sum(F.size("violations")).alias("violations"), F.min_by("url", "ord").alias("first_url")))

# URL expressions
_P = lambda s, d: fx.load(s, d, "pages").select("page_id", "url", "html")
_add("url1_normalize", lambda s, d: _P(s, d).select("page_id", urls.normalize_url(F.col("url")).alias("normalized")))
_add("url2_origin", lambda s, d: _P(s, d).select("page_id", urls.url_origin(F.col("url")).alias("origin")))
_add("url3_path", lambda s, d: _P(s, d).select("page_id", urls.url_path(F.col("url")).alias("path")))
_add("url4_resolve", lambda s, d: _P(s, d).select("page_id", urls.resolve_href(F.lit("../x/./y?a=1#f"), F.col("url")).alias("relative"), urls.resolve_href(F.lit("/z"), F.col("url")).alias("rooted"), urls.resolve_href(F.lit("mailto:a@b"), F.col("url")).alias("other"), urls.resolve_href(F.regexp_extract("html", r'<a href="(/[A-Za-z0-9]*)"', 1), F.col("url")).alias("href")))
_IPS = ["127.0.0.1", "10.1.2.3", "172.16.0.1", "172.32.0.1", "192.168.1.1", "169.254.169.254", "0.0.0.0", "100.64.0.1", "255.255.255.255", "8.8.8.8", "93.184.216.34", "0177.0.0.1", "2130706433", "::1", "fe80::1", "fd00::1", "::ffff:127.0.0.1", "::ffff:8.8.8.8", "2606:4700:4700::1111"]
_ip = lambda: F.element_at(F.array(*map(F.lit, _IPS)), (F.col("page_id") % len(_IPS) + 1).cast("int"))
_add("url5_safe", lambda s, d: _P(s, d).select("page_id", urls.url_is_safe(F.concat(F.when(F.col("page_id") % 3 == 0, "ftp").otherwise("http"), F.lit("://"), F.when(F.contains(_ip(), F.lit(":")), F.concat(F.lit("["), _ip(), F.lit("]"))).otherwise(_ip()), F.lit("/x")))["ok"].alias("ok"), urls.url_is_safe(F.col("url"))["ok"].alias("own_ok")))
_add("url6_private_ip", lambda s, d: _P(s, d).select("page_id", urls.ip_is_private(_ip()).alias("private"), urls.ip_is_private(F.regexp_extract("url", "^[a-z]+://([^/]+)", 1)).alias("host_private")))
_add("url7_logical", lambda s, d: _P(s, d).select("page_id", urls.logical_url(F.col("url")).alias("logical")))
_add("url8_finding_key", lambda s, d: _P(s, d).select("page_id", urls.finding_key(F.col("url"), F.lit("R-TITLE-MISSING"), F.lit(1)).alias("finding_key")))


# Page signals
@query("sig_signals")
def _signals(s, d):
    c = fx.context(s, d, lab=False)
    r = F.col("rendered")
    return c.select("page_id", F.col("raw.title").alias("raw_title"), r["title"].alias("title"), r["h1_text"].alias("h1_text"), r["canonical"].alias("canonical"), r["h1_count"].cast("long").alias("h1_count"), F.lower(r["meta_robots"]).alias("meta_robots"), F.size(r["jsonld_blocks"]).cast("long").alias("blocks"), r["og_title"].alias("og_title"), r["og_url"].alias("og_url"), r["og_description"].alias("og_description"), r["meta_description"].alias("meta_description"), r["images_without_alt"].cast("long").alias("images_without_alt"), F.contains(r["body_text"], F.concat(F.lit("Article "), F.col("k").cast("string"))).alias("body_has_name"))


_add("sig13_signal_diff", lambda s, d: html.signal_diff(fx.context(s, d, lab=False), ["page_id"]).select("page_id", "field"))
_add("sig14_indexing_gap", lambda s, d: fx.context(s, d, lab=False).select("page_id", html.has_indexing_gap().alias("gap")))


@query("sig15_links")
def _links(s, d):
    p = fx.pages(s, d).select("page_id", "url", "html")
    return html.extract_links(html.extract_signals(p, {"html": "raw"}), ["page_id"]).groupBy("page_id").agg(F.count(F.lit(1)).alias("links"))


# Rules
RULE_IDS = [
    "R-CANONICAL-MISSING", "R-CANONICAL-JS-ONLY", "R-NOINDEX-DETECTED", "R-JSONLD-MISSING", "R-JSONLD-INVALID", "R-QA-STRUCTURE-MISSING", "R-JSONLD-PRODUCT-INCOMPLETE", "R-JSONLD-PRODUCT-NAME-MISMATCH",
    "R-OG-BASIC-MISSING", "R-OG-DESCRIPTION-MISSING", "R-META-DESCRIPTION-MISSING", "R-STATUS-4XX", "R-STATUS-5XX", "R-REDIRECT-CHAIN-LONG", "R-RAW-RENDERED-GAP-TITLE", "R-RAW-RENDERED-GAP-METAROBOTS",
    "R-CWV-LCP-POOR", "R-CWV-CLS-POOR", "R-CWV-TBT-POOR", "R-TITLE-MISSING", "R-H1-MISSING", "R-H1-MULTIPLE", "R-IMG-ALT-MISSING",
]


def _rule_query(rule_id: str):
    lab = rule_id.startswith("R-CWV")
    return lambda s, d: violations(s, d, lab=lab).filter(F.col("rule_id") == rule_id).select("url", "rule_id", "category", "severity", "current_value")


def rule_key(i: int) -> str:
    return f"r{i + 1:02d}_" + RULE_IDS[i].removeprefix("R-").lower().replace("-", "_")


for _i, _r in enumerate(RULE_IDS):
    _add(rule_key(_i), _rule_query(_r))


def robots_tables(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = tables.robots_docs(fx.robots_doc(s, d))
    return docs, robots.robots_rules(docs)


def access(s: SparkSession, d: str) -> DataFrame:
    docs, rr = robots_tables(s, d)
    return robots.ai_bot_access(docs, rr, robots.bot_catalog(s))


_add("r24_ai_crawler_policy", lambda s, d: rules.ai_policy_rule(robots.policy_summary(access(s, d)).withColumn("run_id", F.lit("A"))).select("site", "url", "rule_id", "severity", "category"))


def gap(s: SparkSession, d: str) -> DataFrame:
    return sitemap.sitemap_gap(fx.crawl_snapshot(s, d), all_listed(s, d))


def sitemap_roots(s: SparkSession, d: str) -> DataFrame:
    return fx.sites(s, d).select("site", F.concat("site", F.lit("/sitemap.xml")).alias("sitemap_url"), F.lit(0).alias("ord"))


def listed(s: SparkSession, d: str) -> DataFrame:
    """What a crawl's budget takes of the sitemaps."""
    return sitemap.sitemap_urls(fx.sitemap_doc(s, d), sitemap_roots(s, d))


def all_listed(s: SparkSession, d: str) -> DataFrame:
    """All that the sitemaps list: a page is missing only if no entry has it."""
    return sitemap.all_sitemap_urls(fx.sitemap_doc(s, d), sitemap_roots(s, d))


_add("r25_sitemap_missing_url", lambda s, d: rules.sitemap_rule(gap(s, d).groupBy("site", "run_id").agg(F.count(F.lit(1)).alias("missing"))).select("site", "rule_id", "severity", "current_value"))


@query("r26_jsonld_website_missing")
def _website(s, d):
    c = cut(fx.context(s, d, lab=False), "context")
    return rules.website_rule(c, rules.evaluate_rules(c, keep=("page_id",)), BY_PAGE).select("site", "rule_id", "severity", "current_value")


_add("sig15b_link_rows", lambda s, d: html.extract_links(html.extract_signals(fx.pages(s, d).select("page_id", "url", "html"), {"html": "raw"}), ["page_id"]).select("page_id", "link"))

# JSON-LD
_J = lambda s, d: fx.context(s, d, lab=False)
_add("jld1_nodes", lambda s, d: _J(s, d).select("page_id", F.size(jsonld.jsonld_nodes(F.col("jsonld"))).cast("long").alias("nodes"), F.array_join(F.transform(jsonld.jsonld_nodes(F.col("jsonld")), lambda n: F.concat(F.array_join(n["types"], "+"), F.lit(":"), F.coalesce(n["name"], F.lit("-")), F.lit(":"), n["has_offers"].cast("string"))), ",").alias("told")))
_add("jld2_types", lambda s, d: _J(s, d).select("page_id", F.array_join(jsonld.jsonld_types(F.col("jsonld")), ",").alias("types")))
_add("jld3_status", lambda s, d: _J(s, d).select("page_id", F.array_join(jsonld.jsonld_status(F.col("jsonld")), ",").alias("status")))

# Aggregations
_add("agg1_lab_vitals", lambda s, d: vitals.lab_vitals(fx.lab_runs(s, d)).select("url", "lcp_ms", "tbt_ms", "runs_completed"))
_add("agg2_severity_counts", lambda s, d: fi.severity_summary(violations(s, d, lab=False), fx.crawl_snapshot(s, d)).select("site", "critical", "high", "medium", "low", "total", "pages"))
_add("agg3_labels", lambda s, d: fi.severity_summary(violations(s, d, lab=False), fx.crawl_snapshot(s, d)).select("site", "label", "no_pages"))
_add("agg4_baseline", lambda s, d: fi.snapshot(findings(s, d, 1)).select("finding_key", "status", "severity"))
_add("agg5_search_summary", lambda s, d: vitals.search_summary(fx.search_daily(s, d), fx.AS_OF).select("clicks", "impressions", F.round("position", 6).alias("position")))
_add("agg5b_traffic_summary", lambda s, d: vitals.traffic_summary(fx.traffic_daily(s, d), fx.AS_OF))
_add("agg6_all_pages_lack_jsonld", lambda s, d: rules.jsonld_lack(fx.crawl_snapshot(s, d), violations(s, d, lab=False, keep=("page_id",)), BY_PAGE).select("site", "every", "n"))
_add("agg7_token_lists", lambda s, d: robots.policy_summary(access(s, d)).select("site", "robots_found", "summary"))
_add("agg9_truncation", lambda s, d: linkgraph.crawl_summary(reach(s, d, 5), 5).select("site", "truncated", (F.col("visited") + F.col("skipped")).alias("met")))
_add("agg10_skipped", lambda s, d: linkgraph.crawl_summary(reach(s, d, 200)).select("site", "skipped", "visited"))
_add("agg11_request_content", lambda s, d: remediation.request_content(planned(s, d)).select("site", "bucket", "n", "title"))
_add("agg_rollup_severity", lambda s, d: violations(s, d, lab=False).rollup("site", "category", "severity").agg(F.count(F.lit(1)).alias("n")))


# Link graph
def seeds(s: SparkSession, d: str) -> DataFrame:
    return fx.ranked_pages(s, d).filter("n = 1").select("site", "url", F.lit(0).alias("depth"), F.lit(0).alias("ord"))


def may(s: SparkSession, d: str) -> DataFrame:
    docs, rr = robots_tables(s, d)
    return robots.url_allowed(fx.pages(s, d).select("site", "url"), rr, docs, "ExampleBot")


def reach(s: SparkSession, d: str, max_pages: int = 200, polite: bool = True) -> DataFrame:
    return linkgraph.crawl_reach(fx.edges(s, d), fx.crawl_snapshot(s, d), seeds(s, d), may(s, d) if polite else None, max_pages)


_add("grf1_crawl_reach", lambda s, d: reach(s, d).select("site", "url", "depth", "ord", "visit_status"))
_add("grf1b_single_page", lambda s, d: linkgraph.single_page(fx.crawl_snapshot(s, d), seeds(s, d), may(s, d)).select("site", "url", "status_code"))
_add("grf1c_own_site_scan", lambda s, d: reach(s, d, polite=False).select("site", "url", "depth"))

@query("grf5_page_links")
def _page_links(s, d):
    """What a crawl without a budget reaches over links that pages hold, with what the sitemaps list as seeds at depth 1."""
    held = html.extract_links(html.extract_signals(cut(fx.linked_pages(s, d), "linked-pages"), {"html": "raw"}), ["site", "url"])
    mapped = robots.same_origin_seeds(all_listed(s, d).withColumn("root", F.element_at("ord", 1)))
    # All entries are offered, in their order: several may be one URL.
    mapped = ranked(mapped.select("site", "url", "depth", F.col("ord").alias("path")), ["site"], [F.col("path")], "ord").select("site", "url", "depth", "ord")
    return linkgraph.crawl_reach(held, fx.crawl_snapshot(s, d), seeds(s, d).unionByName(mapped), may(s, d), max_pages=None, first="page_id").select("site", "url", "depth", "ord", "visit_status")


@query("agg9b_sitemap_cut")
def _sitemap_cut(s, d):
    """A crawl is cut off by its budget or by that of its sitemaps, which is five URLs here."""
    few = sitemap.sitemap_urls(fx.sitemap_doc(s, d), sitemap_roots(s, d), max_pages=5)
    return linkgraph.crawl_summary(reach(s, d), 200, few).select("site", "truncated")


_add("grf2_sitemap_urls", lambda s, d: listed(s, d).select("site", "ord", "url", "truncated"))
_add("grf3_sitemap_candidates", lambda s, d: robots.robots_sitemaps(fx.sites(s, d), robots_tables(s, d)[1]).select("site", "sitemap_url"))
_add("grf4_seed_filter", lambda s, d: robots.same_origin_seeds(listed(s, d).withColumn("url", F.when(F.col("ord") == 20, F.lit("no url")).when(F.col("ord") % 3 == 0, F.lit("http://elsewhere.example/x")).otherwise(F.col("url")))).select("site", "ord", "url", "depth"))

# Robots, sitemaps, payloads
_add("rob1_rules", lambda s, d: robots_tables(s, d)[1].filter("kind <> 'agent'").select("site", "ua_token", "kind", "pattern"))
_add("rob2_url_allowed", lambda s, d: may(s, d).select("site", "url", "allowed"))


@query("rob4_wildcard_rules")
def _wildcards(s, d):
    """Every page's URL against rules with wildcards, one of them with twenty."""
    docs = tables.robots_docs(fx.wild_robots_doc(s, d))
    return robots.url_allowed(fx.pages(s, d).select("site", "url"), robots.robots_rules(docs), docs, "ExampleBot").select("site", "url", "allowed")


_add("rob3_ai_bot_access", lambda s, d: access(s, d).select("site", "token", "purpose", "allowed", "robots_found"))
_add("smp1_entries", lambda s, d: sitemap.sitemap_entries(fx.sitemap_doc(s, d)).select("site", "sitemap_url", "kind", "ord", "loc"))
_add("smp2_odd_documents", lambda s, d: sitemap.sitemap_entries(fx.odd_sitemap_doc(s, d)).select("site", "sitemap_url", "kind", "ord", "loc"))
_add("fld1_field_vitals", lambda s, d: vitals.field_vitals(fx.field_payloads(s, d)).select("url", "event_id", "field_lcp_ms", "field_cls", "field_inp_ms"))
_search = lambda: F.concat(F.lit('{"rows":[{"clicks":'), F.col("event_id").cast("string"), F.lit(',"impressions":"x","position":'), F.col("value").cast("string"), F.lit("}]}"))
_add("fld2_search_metrics", lambda s, d: vitals.search_metrics(fx.load(s, d, "events").select(F.col("event_id").cast("string").alias("property_scope"), F.when(F.col("event_id") % 7 != 0, _search()).otherwise("{}").alias("payload"))))
_traffic = lambda: F.concat(F.lit('{"rows":[{"metricValues":["'), F.col("event_id").cast("string"), F.lit('",{"value":"'), F.col("user_id").cast("string"), F.lit('"}]}]}'))
_add("fld3_traffic_metrics", lambda s, d: vitals.traffic_metrics(fx.load(s, d, "events").select(F.col("event_id").cast("string").alias("property_id"), F.when(F.col("event_id") % 7 != 0, _traffic()).otherwise("{}").alias("payload"))))

# Joins
_add("join1_lab", lambda s, d: vitals.attach_vitals(fx.crawl_snapshot(s, d).select("site", "url", "depth", "page_id"), vitals.lab_vitals(fx.lab_runs(s, d))).select("page_id", "lcp_ms"))

@query("join1b_bucketed")
def _bucketed(s, d):
    """Pages and lab vitals as tables in buckets of (site, url): the join shuffles neither."""
    path, name = shared_folder(s), uuid.uuid4().hex
    p = tables.save_bucketed(fx.crawl_snapshot(s, d).select("site", "url", "depth", "status_code"), path, f"pages_{name}")
    v = tables.save_bucketed(vitals.lab_vitals(fx.lab_runs(s, d)), path, f"lab_{name}")
    return vitals.attach_vitals(p, v).select("url", "depth", "lcp_ms", "tbt_ms")


_add("join2_field", lambda s, d: vitals.attach_vitals(fx.crawl_snapshot(s, d).select("site", "url", "depth", "page_id"), None, fx.field_by_page(s, d)).select("page_id", "field_lcp_ms", "field_cls", "field_inp_ms"))
_add("join3_url_rules", lambda s, d: may(s, d).groupBy("site", "state").agg(F.count_if("allowed").alias("allowed"), F.count(F.lit(1)).alias("urls")))
_add("join4_bots", lambda s, d: access(s, d).groupBy("token").agg(F.count_if("allowed").alias("allowed"), F.count(F.lit(1)).alias("sites")))
_add("join5_regressions", lambda s, d: fi.classify_regressions(findings(s, d, 1), fi.snapshot(findings(s, d))).select("finding_key", "kind"))
_add("join5b_resolved", lambda s, d: fi.resolved(findings(s, d, 1), fi.snapshot(findings(s, d))).select("finding_key"))
_add("join6_sitemap_gap", lambda s, d: gap(s, d).select("site", "path"))
_add("join6b_proposed_urls", lambda s, d: sitemap.proposed_urls(gap(s, d), all_listed(s, d)).select("site", "path", "url"))
_add("join7_applicable", lambda s, d: remediation.applicable(applied(s, d), findings(s, d)).select("finding_key", "rule_id", "severity"))
_add("join8_catalog", lambda s, d: findings(s, d).join(F.broadcast(remediation.catalog(s)), "rule_id", "left").select("finding_key", "rule_id", "risk_level"))
_add("join9_page_values", lambda s, d: findings(s, d).filter("rule_id = 'R-CANONICAL-JS-ONLY'").select("site", "url", "page_id").join(fx.context(s, d, lab=False).select("site", "url", "page_id", F.col("rendered.canonical").alias("canonical")), ["site", "url", "page_id"]).drop("page_id"))
_add("join10_open_requests", lambda s, d: planned(s, d).groupBy("bucket", "branch_name").agg(F.count(F.lit(1)).alias("n")))
_add("join11_decorated", lambda s, d: fi.decorate(fi.classify_regressions(findings(s, d, 1), fi.snapshot(findings(s, d))), findings(s, d, 1)).select("finding_key", "kind", "rule_id", "severity"))
_add("join12_index_children", lambda s, d: listed(s, d).groupBy("site").agg(F.count(F.lit(1)).alias("urls"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "url"))), lambda x: x["url"]), " "), 256).alias("urls_sha256")))
_add("join13_frontier", lambda s, d: reach(s, d, polite=False).groupBy("site", "depth").agg(F.count(F.lit(1)).alias("pages"), F.min_by("url", "ord").alias("first_url"), F.max_by("url", "ord").alias("last_url")))

# Windows, orders, sets
_add("win1_latest_runs", lambda s, d: fi.latest_finished_runs(runs(s, d)).select("project_id", "id"))
_add("win2_latest_baselines", lambda s, d: fi.latest_by(runs(s, d).select("id", "project_id"), ["project_id"], "id"))
_add("win3_latest_projects", lambda s, d: fi.latest_by(runs(s, d).select("id", (F.col("project_id") % 5).alias("target")), ["target"], "id"))
_add("win4_impact_order", lambda s, d: fi.impact_order(violations(s, d, lab=False)).select("url", "rule_id", "place"))
_add("win5_first_violation", lambda s, d: violations(s, d, lab=False).filter("rule_id = 'R-JSONLD-INVALID'").select("url", "current_value"))
_add("win6_site_titles", lambda s, d: remediation.site_titles(fx.context(s, d, lab=False).withColumn("ord", F.col("page_id"))).select("site", "site_title"))
_add("win7_first_discovery", lambda s, d: linkgraph.first_discovery(fx.edges(s, d).select("site", F.col("link").alias("url"), F.lit(0).cast("long").alias("parent_ord"), F.col("pos").cast("long").alias("pos"))).select("site", "url", "pos"))
_add("win8_page_budget", lambda s, d: linkgraph.within_budget(fx.pages(s, d).select("site", "url", F.lit(0).alias("parent_ord"), F.col("page_id").alias("pos")), 3).select("site", "url", "n"))
_add("win9_sitemap_caps", lambda s, d: sitemap.sitemap_urls(fx.sitemap_doc(s, d), fx.sites(s, d).select("site", F.concat("site", F.lit("/sitemap.xml")).alias("sitemap_url"), F.lit(0).alias("ord")), 2, 1).select("site", "ord", "url", "truncated"))
_add("win10_schedule", lambda s, d: linkgraph.crawl_schedule(fx.pages(s, d).select("site", "url", F.col("page_id").alias("ord")), now(), 2.0).select("url", "ord", F.unix_millis("starts_at").alias("starts_ms")))
_add("win11_history", lambda s, d: tables.history(fi.classify_regressions(findings(s, d, 1), fi.snapshot(findings(s, d))).join(findings(s, d, 1).select("finding_key", "id"), "finding_key").select("id", "kind")))
_add("win12_listing", lambda s, d: fi.decorate(fi.classify_regressions(findings(s, d, 1), fi.snapshot(findings(s, d))), findings(s, d, 1)).select("site", "rule_id", "url", "place"))


@query("set1_all_violations")
def _all(s, d):
    c = cut(fx.context(s, d, lab=False), "context")
    kept = rules.evaluate_rules(c, keep=("page_id",))
    v = kept.drop("page_id")
    ai = rules.ai_policy_rule(robots.policy_summary(access(s, d)).withColumn("run_id", F.lit("A")))
    sm = rules.sitemap_rule(gap(s, d).groupBy("site", "run_id").agg(F.count(F.lit(1)).alias("missing")))
    return v.unionByName(ai).unionByName(sm).unionByName(rules.website_rule(c, kept, BY_PAGE)).groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"), F.min("url").alias("first_url"), F.max("url").alias("last_url"))


_add("set2_distinct_paths", lambda s, d: fx.pages(s, d).select("site", urls.url_path(F.col("url")).alias("path")).distinct())
_add("set3_except", lambda s, d: gap(s, d).groupBy("site").agg(F.count(F.lit(1)).alias("missing")))
_add("set4_split", lambda s, d: plans(s, d).groupBy("fix_type").agg(F.count(F.lit(1)).alias("n")))


_add("set4b_split_rows", lambda s, d: plans(s, d).select("site", "finding_key", "rule_id", "risk_level", "fix_type", "approval_status"))


# Remediation
def plans(s: SparkSession, d: str) -> DataFrame:
    c = cut(fx.context(s, d, lab=False).withColumn("ord", F.col("page_id")), "context")
    gaps = cut(gap(s, d), "gap")
    missing = gaps.groupBy("site", "run_id").agg(F.array_sort(F.collect_list("path")).alias("paths"))
    docs = cut(tables.robots_docs(fx.robots_doc(s, d)), "robots-docs")
    bots = cut(robots.ai_bot_access(docs, robots.robots_rules(docs), robots.bot_catalog(s)), "access")
    ai = rules.ai_policy_rule(robots.policy_summary(bots).withColumn("run_id", F.lit("A")))
    v = rules.evaluate_rules(c, keep=("page_id",))
    sm = rules.sitemap_rule(gaps.groupBy("site", "run_id").agg(F.count(F.lit(1)).alias("missing")))
    of_site = ai.unionByName(sm).unionByName(rules.website_rule(c, v, BY_PAGE)).withColumn("page_id", F.lit(None).cast("long"))
    every = fi.to_findings(v.unionByName(of_site))
    return remediation.plan(every, c, missing, docs, bots, remediation.site_titles(c), remediation.catalog(s), BY_PAGE)


def _of(rule_id: str, *cols: str):
    return lambda s, d: plans(s, d).filter(F.col("rule_id") == rule_id).select("site", "url", "fix_type", "approval_status", *cols)


@query("rem10b_add_only_rows")
def _add_only_rows(s, d):
    """What is proposed when the directives and titles that were proposed before are there already."""
    p = cut(plans(s, d).filter("marker is not null"), "plans")
    return remediation.add_only(p, p.filter("rule_id IN ('R-NOINDEX-DETECTED', 'R-TITLE-MISSING')")).select("site", "rule_id", "finding_key")


_add("rem1_catalog", lambda s, d: remediation.catalog(s).join(plans(s, d).select("rule_id").distinct(), "rule_id", "left_semi").select("rule_id", "risk_level"))
_add("rem2_sitemap", lambda s, d: _of("R-SITEMAP-MISSING-URL", "marker")(s, d).select("site", "approval_status", "marker"))
_add("rem2b_sitemap_parts", lambda s, d: sitemap.missing_parts(gap(s, d), 5).select("site", "part", "n", "marker"))
_add("rem3_canonical", _of("R-CANONICAL-MISSING", "marker"))
_add("rem4_js_canonical", _of("R-CANONICAL-JS-ONLY", "marker"))
_add("rem5_og", lambda s, d: _of("R-OG-BASIC-MISSING", "marker")(s, d).select("url", "fix_type", F.get_json_object("marker", "$.url").alias("og_url"), F.get_json_object("marker", "$.title").alias("og_title")))
_add("rem6_noindex", _of("R-NOINDEX-DETECTED", "marker"))
_add("rem7_ai_policy", lambda s, d: _of("R-AI-CRAWLER-POLICY", "marker")(s, d).select("site", "fix_type", "marker"))
_add("rem8_website", lambda s, d: _of("R-JSONLD-WEBSITE-MISSING", "marker")(s, d).select("site", "fix_type", "approval_status", F.get_json_object("marker", "$.name").alias("name")))
_add("rem9_title", lambda s, d: _of("R-TITLE-MISSING", "marker")(s, d).select("url", "fix_type", "marker"))
@query("rem10_add_only")
def _add_only(s, d):
    p = cut(plans(s, d).filter("marker is not null"), "plans")
    return remediation.add_only(p, p.filter("rule_id = 'R-NOINDEX-DETECTED'")).groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))


def decisions(plans: DataFrame) -> DataFrame:
    third = F.pmod(F.conv(F.substring("finding_key", 1, 8), 16, 10).cast("long"), F.lit(3))
    return plans.filter("rule_id = 'R-CANONICAL-MISSING'").select("finding_key", F.when(third == 0, "approved").when(third == 1, "rejected").alias("decision")).filter("decision is not null")


def decided(s: SparkSession, d: str) -> DataFrame:
    p = cut(plans(s, d), "plans")
    return remediation.decide(p, decisions(p))


def applied(s: SparkSession, d: str, outcomes: bool = False) -> DataFrame:
    p = decided(s, d).select("*", F.lit(None).cast("timestamp").alias("applied_at"), F.lit(None).cast("string").alias("backup"), F.lit("open").alias("finding_status"))
    if not outcomes:
        return p
    done = decisions(p).select("finding_key", now().alias("applied_at"), F.lit("b").alias("backup"))
    return remediation.mark_applied(p, done)


def _rolled_back(s: SparkSession, d: str) -> DataFrame:
    a = cut(applied(s, d, True), "applied")
    return remediation.rollback(a, decisions(a))


_C = "rule_id = 'R-CANONICAL-MISSING'"
_add("rem11_decide", lambda s, d: decided(s, d).filter(_C).groupBy("approval_status", "changed").agg(F.count(F.lit(1)).alias("n")))
_add("rem12_apply", lambda s, d: applied(s, d, True).filter(_C).groupBy("approval_status", "finding_status").agg(F.count(F.lit(1)).alias("n"), F.count("applied_at").alias("applied")))
_add("rem13_rollback", lambda s, d: _rolled_back(s, d).filter(_C).groupBy("approval_status", "finding_status").agg(F.count(F.lit(1)).alias("n"), F.count("applied_at").alias("applied")))

@query("rem19_stored_states")
def _stored(s, d):
    """Decisions, applications and rollbacks as merges of a stored table, each run twice; what is read back."""
    path = f"{shared_folder(s)}/{uuid.uuid4().hex}"
    approvals.store_plans(cut(plans(s, d).filter(_C), "plans"), path)
    d1 = decisions(versioned.read(s, path))
    done = versioned.read(s, path).select("finding_key", now().alias("applied_at"), F.lit("b").alias("backup"))
    back = done.filter(F.conv(F.substring("finding_key", 9, 6), 16, 10).cast("long") % 2 == 0)
    for _ in range(2):
        approvals.decide(s, path, d1, "decide")
        approvals.apply(s, path, done, "apply")
        approvals.rollback(s, path, back, "roll back")
        approvals.decide(s, path, d1.withColumn("decision", F.lit("rejected")), "decide again")
    return versioned.read(s, path).select("finding_key", "approval_status", F.col("applied_at").isNotNull().alias("applied"), "finding_status")


@query("rem20_stored_requests")
def _stored_requests(s, d):
    """Open change requests in a stored table are closed or merged by a merge; then those of a live list suppress plans too."""
    path = f"{shared_folder(s)}/{uuid.uuid4().hex}"
    rows = fx.pages(s, d).select(F.col("page_id").alias("id"), "site", F.concat(F.lit("b"), (F.col("page_id") % 9).cast("string")).alias("branch_name"), F.when(F.col("page_id") % 4 == 0, "merged").otherwise("open").alias("state"))
    versioned.create(rows, path, ["id"])
    states = rows.filter("id % 3 = 0").select("id", F.when(F.col("id") % 2 == 0, "closed").otherwise("merged").alias("new_state"))
    for _ in range(2):
        approvals.update_requests(s, path, states, "states")
    return versioned.read(s, path)


@query("rem21_stored_acknowledgements")
def _stored_acks(s, d):
    """Findings of every third page are acknowledged in the stored table; the next baseline carries it."""
    path = f"{shared_folder(s)}/{uuid.uuid4().hex}"
    f = cut(findings(s, d).select("site", "finding_key", "id", "page_id", "category", "severity", "status"), "findings")
    versioned.create(f, path, ["site", "finding_key", "id"])
    approvals.acknowledge(s, path, f.filter("page_id % 3 = 0").select("site", "finding_key"), "acknowledge")
    return fi.snapshot(versioned.read(s, path)).select("site", "finding_key", "status", "severity")


@query("join10b_live_requests")
def _live(s, d):
    """Planned requests without those that are open in the store or in the live list: sites of rank % 3 = 1 there."""
    taken = fx.sites(s, d).filter("rank % 2 = 0").select("site", F.lit("site/fix-r-canonical-missing").alias("branch_name"), F.lit("open").alias("state"))
    live = fx.sites(s, d).filter("rank % 3 = 1").select("site", F.lit("site/fix-r-noindex-detected").alias("branch_name"))
    return remediation.buckets(plans(s, d), taken, live).select("site", "bucket", "branch_name", "finding_key")


_add("agg11b_request_lines", lambda s, d: remediation.request_lines(planned(s, d)).select("site", "bucket", "line"))
_add("rem14_outcomes", lambda s, d: remediation.outcome_counts(fx.pages(s, d).select("site", F.element_at(F.array(*map(F.lit, remediation.OUTCOMES)), (F.col("page_id") % 4 + 1).cast("int")).alias("outcome"))))


def planned(s: SparkSession, d: str) -> DataFrame:
    taken = fx.sites(s, d).filter("rank % 2 = 0").select("site", F.lit("site/fix-r-canonical-missing").alias("branch_name"), F.lit("open").alias("state"))
    return remediation.buckets(plans(s, d), taken)


_add("rem15_buckets", lambda s, d: planned(s, d).groupBy("bucket").agg(F.count(F.lit(1)).alias("n")))
_add("rem15b_bucket_rows", lambda s, d: planned(s, d).select("site", "bucket", "branch_name", "finding_key"))
_add("rem16_acknowledge", lambda s, d: fi.acknowledge(findings(s, d), findings(s, d).filter("page_id % 3 = 0").select("site", "finding_key")).groupBy("status").agg(F.count(F.lit(1)).alias("n")))


@query("rem17_policy")
def _policy(s, d):
    r = fx.pages(s, d).select("page_id", (F.col("page_id") % 5 == 0).alias("is_archived"), (F.col("page_id") % 7 == 0).alias("is_disabled"), (F.col("page_id") % 2 == 0).alias("has_license"), (F.col("page_id") % 3 == 0).alias("has_contributing"))
    return remediation.policy(r).select("page_id", "allowed", "reason", F.array_join("warnings", ",").alias("warnings"))


@query("rem18_request_states")
def _requests(s, d):
    r = fx.pages(s, d).select(F.col("page_id").alias("id"), F.when(F.col("page_id") % 4 == 0, "merged").otherwise("open").alias("state"))
    n = fx.pages(s, d).filter("page_id % 3 = 0").select(F.col("page_id").alias("id"), F.when(F.col("page_id") % 2 == 0, "closed").otherwise("merged").alias("new_state"))
    return remediation.update_requests(r, n).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


# Scalar functions
_add("fn_text", lambda s, d: fx.load(s, d, "documents").select("doc_id", F.sha2(text.excerpt(F.coalesce("text", F.lit(""))), 256).alias("excerpt_sha256"), text.slug(F.col("source"), "x/").alias("slug"), text.mask_secret(F.lit("a b?k=to ken&to%20ken"), F.lit("to ken")).alias("masked"), F.sha2(text.mask_secret(F.col("text"), F.lit("and the")), 256).alias("masked_sha256"), F.sha2(text.script_safe(F.concat(F.lit("</script>"), "text")), 256).alias("safe_sha256")))
_add("fn_space", lambda s, d: fx.load(s, d, "documents").select("doc_id", F.sha2(text.trim_all(F.concat(F.lit("\u00a0\t\u2003"), "text", F.lit("\ufeff \u3000"))), 256).alias("trimmed_sha256"), F.sha2(text.collapse(F.concat(F.lit(" \u2003 a\u00a0\n b"), "text")), 256).alias("collapsed_sha256")))
_add("fn_enum", lambda s, d: fx.load(s, d, "events").select("event_id", text.one_of(F.col("event_type"), ["view", "click", "purchase", "error", "scroll", "signup", "login", "logout", "add_to_cart", "search"]).alias("event_type")))
_add("fn_table_cell", lambda s, d: fx.load(s, d, "documents").select("doc_id", F.sha2(text.table_cell(F.col("text")), 256).alias("cell_sha256")))
_add("fn_numbers", lambda s, d: fx.load(s, d, "events").select("event_id", F.round(text.finite(F.col("value"))).cast("long").alias("rounded"), (F.col("value") / 100).alias("hundredth"), text.fixed(F.col("value"), 1).alias("decimals")))


# Extension points
@query("udf1_extra_rule")
def _extra(s, d):
    more = rules.register_rule(rules.page_rules(), "X-TEAPOT", 1, "meta", "low", F.col("status_code") == 301, F.lit("moved"), "none")
    return rules.evaluate_rules(fx.context(s, d, lab=False), more).filter("rule_id = 'X-TEAPOT'").select("url", "rule_id", "current_value")


_add("udf2_one_parse", lambda s, d: html.extract_signals(fx.pages(s, d).select("page_id", "html"), {"html": "raw"}).select("page_id", F.col("raw.h1_count").cast("long").alias("h1_count"), F.size("raw.links").cast("long").alias("hrefs")))
_add("udf3_fixer_rows", lambda s, d: plans(s, d).groupBy("rule_id", "risk_level").agg(F.count(F.lit(1)).alias("n")))


@query("url9_host_spellings")
def _spellings(s, d):
    """One key for every spelling of a host, by columns and by SQL functions."""
    urls.register_sql(s)
    u = fx.odd_hosts(s, d).select("page_id", "url", F.expr("normalize_url(url)").alias("by_sql"), F.expr("url_is_safe(url)").alias("safe_by_sql"), F.expr("finding_key(url, 'R', 1)").alias("key"))
    return u.select("page_id", urls.normalize_url(F.col("url")).alias("url"), "by_sql", urls.url_is_safe(F.col("url"))["ok"].alias("safe"), "safe_by_sql", "key")


@query("udf4_sql_functions")
def _sql(s, d):
    urls.register_sql(s)
    return _P(s, d).select("page_id", F.expr("normalize_url(url)").alias("normalized"), F.expr("finding_key(url, 'R-X', 1)").alias("finding_key"), F.expr("url_is_safe(url)").alias("safe"))


# Streams, replayed over the same rows as batches: files of the table go through the streaming form
def _replay(s: SparkSession, df: DataFrame, name: str) -> DataFrame:
    path = f"{shared_folder(s)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/in")
    return s.readStream.schema(df.schema).parquet(f"{path}/in"), path


def _drain(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    q = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/out")


def _snapshots(s: SparkSession, d: str) -> tuple[DataFrame, str]:
    rows = fx.crawl_snapshot(s, d).withColumn("fetched_at", F.timestamp_seconds(F.lit(1706745600) + F.col("page_id")))
    return _replay(s, rows, "snapshots")


@query("str1_stream_findings")
def _str1(s, d):
    stream, path = _snapshots(s, d)
    return _drain(streams.stream_findings(stream).select("url", "rule_id", "finding_key"), path).groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))


def _timed(s: SparkSession, d: str, shift: int) -> tuple[DataFrame, str]:
    return _replay(s, findings(s, d, shift).withColumn("fetched_at", F.timestamp_seconds(F.lit(1706745600) + F.col("page_id"))), "findings")


@query("str1b_batches_stored_once")
def _str1b(s, d):
    """Snapshots in many files, three micro-batches and more; the job is started twice, and nothing is stored twice."""
    rows = fx.crawl_snapshot(s, d).withColumn("fetched_at", F.timestamp_seconds(F.lit(1706745600) + F.col("page_id")))
    path = f"{shared_folder(s)}/{uuid.uuid4().hex}"
    rows.repartition(20, "page_id").write.parquet(f"{path}/in")
    for _ in range(2):
        found = streams.stream_findings(streams.stream_snapshots(s, f"{path}/in", rows.schema)).select("url", "rule_id", "finding_key", "severity")
        streams.write_once(found, f"{path}/out", f"{path}/state")
    return streams.stored(s, f"{path}/out", "url string, rule_id string, finding_key string, severity string").drop("batch")


@query("str2b_late_rows")
def _str2b(s, d):
    """Micro-batches in turn: pages of remainder 0, those of 1 ten days on, the same again, then those of 2 at the first time, too late."""
    rows = cut(findings(s, d, 1).select("finding_key", "page_id"), "findings")
    path = f"{shared_folder(s)}/{uuid.uuid4().hex}"
    for k, days in ((0, 0), (1, 10), (1, 10), (2, 0)):
        rows.filter(F.col("page_id") % 3 == k).select("finding_key", F.timestamp_seconds(F.lit(1706745600 + 86400 * days) + F.col("page_id")).alias("fetched_at")).coalesce(1).write.mode("append").parquet(f"{path}/in")
    stream = s.readStream.schema("finding_key string, fetched_at timestamp").option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    streams.write_once(streams.alerts_once(stream).select("finding_key"), f"{path}/out", f"{path}/state")
    return streams.stored(s, f"{path}/out", "finding_key string").drop("batch")


@query("str2_alerts_once")
def _str2(s, d):
    stream, path = _timed(s, d, 1)
    return _drain(streams.alerts_once(stream.unionByName(stream)).select("finding_key"), path)


@query("str3_stream_alerts")
def _str3(s, d):
    stream, path = _timed(s, d, 1)
    return _drain(streams.stream_alerts(stream, fi.snapshot(findings(s, d))).select("finding_key"), path)


@query("str4_stream_vitals")
def _str4(s, d):
    e = fx.load(s, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("u"), (F.col("event_id") % 10).cast("string")).alias("url"), F.col("value").alias("lcp_ms"))
    stream, path = _replay(s, e, "vitals")
    return _drain(streams.stream_vitals(stream, "1 day"), path).select(F.unix_timestamp("window_start").alias("window_start"), "url", "runs")


@query("str4b_sliding_medians")
def _str4b(s, d):
    """Medians in windows of two days that slide by one."""
    e = fx.load(s, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("u"), (F.col("event_id") % 10).cast("string")).alias("url"), F.col("value").alias("lcp_ms"))
    stream, path = _replay(s, e, "vitals")
    return _drain(streams.stream_vitals(stream, "2 days", "1 day"), path).select(F.unix_timestamp("window_start").alias("window_start"), "url", "lcp_ms", "runs")
