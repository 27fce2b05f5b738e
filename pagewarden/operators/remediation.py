"""What to do about a finding: catalog, proposals, gates, and the state of each proposal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import has, script_safe, slug
from ..functions.urls import url_path
from ..sources.staging import cut

# Rules that have an action, and its risk.
FIXERS = [
    ("R-SITEMAP-MISSING-URL", "add_safe", "add the missing URLs to the sitemap"),
    ("R-CANONICAL-MISSING", "gated", "add a canonical link to the page's own path"),
    ("R-CANONICAL-JS-ONLY", "gated", "serve the canonical link that rendering shows"),
    ("R-OG-BASIC-MISSING", "gated", "add og:title and og:url from the page's own values"),
    ("R-AI-CRAWLER-POLICY", "gated", "add a crawler policy where there is none"),
    ("R-NOINDEX-DETECTED", "gated", "allow indexing"),
    ("R-JSONLD-WEBSITE-MISSING", "gated", "describe the site with its home page's title"),
    ("R-TITLE-MISSING", "gated", "use the page's first heading as title"),
]


def catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FIXERS, "rule_id string, risk_level string, description string")


def site_titles(pages: DataFrame) -> DataFrame:
    """Rendered title of each site's home page, else of its first page. pages: site, run_id, url, ord, rendered."""
    not_home = url_path(F.col("url")) != "/"
    return pages.groupBy("site", "run_id").agg(F.min_by("rendered.title", F.struct(F.coalesce(not_home, F.lit(True)), F.col("ord"))).alias("site_title"))


#: Rules whose proposal needs values of the page, and rules of a whole site.
PAGE_VALUES = ("R-CANONICAL-JS-ONLY", "R-OG-BASIC-MISSING", "R-TITLE-MISSING")
OF_SITE = ("R-SITEMAP-MISSING-URL", "R-AI-CRAWLER-POLICY", "R-JSONLD-WEBSITE-MISSING")


def plan(findings: DataFrame, signals: DataFrame, missing: DataFrame, states: DataFrame, access: DataFrame, titles: DataFrame, fixers: DataFrame, by: tuple[str, ...] = ("site", "run_id", "url")) -> DataFrame:
    """A proposal for each finding.

    signals: site, run_id, url, rendered; missing: site, run_id, paths (array); states: site, state; access: the AI
    access table; titles: site, run_id, site_title. Findings without an action, or whose action has no value to offer,
    are report_only. The sitemap proposal is approved by itself (add_safe); all others wait. by: what tells the pages of
    signals apart, in findings too; where a URL was fetched more than once, it names a column beside the URL.

    Findings are staged and split by what their rule needs: pages' values are joined to findings of those rules alone,
    and each site's values to its one finding of their rule.
    """
    f = cut(findings.select(*dict.fromkeys(("site", "run_id", "url", *by)), "rule_id", "finding_key").join(F.broadcast(fixers.select("rule_id", "risk_level")), "rule_id", "left"), "plan-findings")
    rule = F.col("rule_id")
    s = signals.select(*by, F.col("rendered.canonical").alias("c"), F.col("rendered.title").alias("t"), F.col("rendered.h1_text").alias("h1"))
    og = F.to_json(F.struct(F.when(has(F.col("t")), F.col("t")).alias("title"), F.when(has(F.col("c")), F.col("c")).alias("url")))
    of_page = f.filter(rule.isin(*PAGE_VALUES)).join(s, list(by), "left").withColumn(
        "value",
        F.when((rule == "R-CANONICAL-JS-ONLY") & has(F.col("c")), F.col("c"))
        .when((rule == "R-OG-BASIC-MISSING") & (has(F.col("t")) | has(F.col("c"))), og)
        .when((rule == "R-TITLE-MISSING") & has(F.col("h1")), F.col("h1")),
    )
    plain = f.filter(~rule.isin(*PAGE_VALUES, *OF_SITE)).withColumn("value", F.when(rule == "R-CANONICAL-MISSING", url_path(F.col("url"))).when(rule == "R-NOINDEX-DETECTED", "index: true"))
    training = access.filter("purpose = 'training'").groupBy("site").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "token"))), lambda x: x["token"]), ", ").alias("training"))
    website = script_safe(F.to_json(F.struct(F.lit("https://schema.org").alias("@context"), F.lit("WebSite").alias("@type"), F.col("site_title").alias("name"))))
    own = lambda r: f.filter(rule == r)
    listed = own("R-SITEMAP-MISSING-URL").join(missing, ["site", "run_id"], "left").withColumn("value", F.when(F.size("paths") > 0, F.to_json("paths")))
    policy_ = own("R-AI-CRAWLER-POLICY").join(states.select("site", "state"), "site", "left").join(training, "site", "left")
    policy_ = policy_.withColumn("value", F.when((F.col("state") == "absent") & has(F.col("training")), F.concat(F.lit("disallow: "), F.col("training"))))
    named = own("R-JSONLD-WEBSITE-MISSING").join(titles, ["site", "run_id"], "left").withColumn("value", F.when(has(F.col("site_title")), website))
    cols = ["site", "run_id", "url", "rule_id", "finding_key", "risk_level", "value"]
    j = of_page.select(*cols)
    for part in (plain, listed, policy_, named):
        j = j.unionByName(part.select(*cols))
    j = j.withColumn("marker", F.when(F.col("risk_level").isNotNull(), F.col("value")))
    offers = F.col("marker").isNotNull()
    return j.select(
        "site", "run_id", "url", "rule_id", "finding_key", F.when(offers, "file_edit").otherwise("report_only").alias("fix_type"), F.when(offers, F.col("risk_level")).alias("risk_level"),
        "marker", F.when(~offers, None).when(F.col("risk_level") == "add_safe", "auto").otherwise("pending").alias("approval_status"),
    )


def add_only(plans: DataFrame, existing: DataFrame) -> DataFrame:
    """Drops proposals whose (site, rule_id, marker) is there already, so planning again proposes nothing again."""
    keys = ["site", "rule_id", "marker"]
    return plans.join(existing.select(*keys).distinct(), keys, "left_anti")


def decide(plans: DataFrame, decisions: DataFrame) -> DataFrame:
    """decisions: finding_key, decision (approved or rejected). Only pending proposals change; `changed` says which did."""
    d = decisions.select("finding_key", "decision").groupBy("finding_key").agg(F.min("decision").alias("decision"))
    j = plans.join(d, "finding_key", "left")
    hit = F.coalesce((F.col("approval_status") == "pending") & F.col("decision").isin("approved", "rejected"), F.lit(False))
    return j.withColumn("changed", hit).withColumn("approval_status", F.when(F.col("changed"), F.col("decision")).otherwise(F.col("approval_status"))).drop("decision")


def applicable(plans: DataFrame, findings: DataFrame) -> DataFrame:
    """Approved proposals not applied yet, with the findings they are about."""
    f = findings.select("site", "run_id", "finding_key", "severity", "current_value")
    return plans.filter(F.col("approval_status").isin("auto", "approved") & F.col("applied_at").isNull()).join(f, ["site", "run_id", "finding_key"])


def mark_applied(plans: DataFrame, outcomes: DataFrame) -> DataFrame:
    """outcomes: finding_key, applied_at, backup. Only auto and approved proposals take it; their finding is fixed."""
    o = outcomes.groupBy("finding_key").agg(F.max("applied_at").alias("__at"), F.max_by("backup", "applied_at").alias("__backup"))
    j = plans.join(o, "finding_key", "left")
    ok = F.coalesce(F.col("approval_status").isin("auto", "approved") & F.col("__at").isNotNull(), F.lit(False))
    return j.select(*plans.columns, ok.alias("__ok"), "__at", "__backup").select(
        *[c for c in plans.columns if c not in ("applied_at", "backup", "finding_status")],
        F.when(F.col("__ok"), F.col("__at")).otherwise(F.col("applied_at")).alias("applied_at"),
        F.when(F.col("__ok"), F.col("__backup")).otherwise(F.col("backup")).alias("backup"),
        F.when(F.col("__ok"), "fixed").otherwise(F.col("finding_status")).alias("finding_status"),
    )


def rollback(plans: DataFrame, keys: DataFrame) -> DataFrame:
    """Applied proposals of the given keys are taken back; their finding is reverted."""
    k = keys.select("finding_key").distinct().withColumn("__back", F.lit(True))
    back = F.coalesce(F.col("__back") & F.col("applied_at").isNotNull(), F.lit(False))
    j = plans.join(k, "finding_key", "left").withColumn("__b", back)
    return j.withColumn("finding_status", F.when(F.col("__b"), "reverted").otherwise(F.col("finding_status"))).withColumn("applied_at", F.when(~F.col("__b"), F.col("applied_at"))).drop("__b", "__back")


OUTCOMES = ("applied", "already_applied", "build_failed", "structure_changed")


def outcome_counts(outcomes: DataFrame) -> DataFrame:
    """Rows of each outcome and how many of them count as success."""
    ok = F.col("outcome").isin("applied", "already_applied")
    return outcomes.groupBy("site", "outcome").agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("successes"))


def branch(rule_id, prefix: str = "site/fix-"):
    return slug(rule_id, prefix)


def buckets(plans: DataFrame, open_requests: DataFrame, live: DataFrame | None = None) -> DataFrame:
    """Planned change requests: safe (auto) and review (pending or approved) apart, one branch for each rule.

    A branch of the site that is open in the store, or in the live list, is left out.
    """
    p = plans.filter(F.col("approval_status").isin("auto", "pending", "approved"))
    p = p.withColumn("bucket", F.when(F.col("approval_status") == "auto", "safe").otherwise("review")).withColumn("branch_name", branch(F.col("rule_id")))
    taken = open_requests.filter("state = 'open'").select("site", "branch_name")
    if live is not None:
        taken = taken.unionByName(live.select("site", "branch_name"))
    return p.join(taken.distinct(), ["site", "branch_name"], "left_anti")


def request_lines(planned: DataFrame) -> DataFrame:
    """(site, bucket, line): a request's body as rows, so a site of any size is no single string."""
    line = F.concat(F.lit("- "), F.col("rule_id"), F.lit(" ("), F.col("risk_level"), F.lit(") "), F.col("url"))
    return planned.select("site", "bucket", line.alias("line"))


def request_content(planned: DataFrame) -> DataFrame:
    """Title and body of each (site, bucket): the rule's name if it is one change, else the count; a line for each."""
    line = F.concat(F.lit("- "), F.col("rule_id"), F.lit(" ("), F.col("risk_level"), F.lit(") "), F.col("url"))
    g = planned.groupBy("site", "bucket").agg(F.count(F.lit(1)).alias("n"), F.min("rule_id").alias("rule"), F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("body"))
    title = F.when(F.col("n") == 1, F.concat(F.lit("Proposed fix: "), F.col("rule"))).otherwise(F.concat(F.lit("Proposed fixes: "), F.col("n").cast("string")))
    return g.select("site", "bucket", "n", title.alias("title"), "body")


def policy(repos: DataFrame) -> DataFrame:
    """Archived and disabled repositories are blocked; missing license or contributing notes are warnings."""
    reason = F.when(F.col("is_archived"), "archived").when(F.col("is_disabled"), "disabled")
    warnings = F.array_compact(F.array(F.when(~F.col("has_license"), "no license"), F.when(~F.col("has_contributing"), "no contributing notes")))
    return repos.select("*", reason.isNull().alias("allowed"), reason.alias("reason"), warnings.alias("warnings"))


def update_requests(requests: DataFrame, states: DataFrame) -> DataFrame:
    """states: id, new_state. Open requests become closed or merged; others stay."""
    j = requests.join(states.select("id", "new_state"), "id", "left")
    hit = (F.col("state") == "open") & F.col("new_state").isin("closed", "merged")
    return j.withColumn("state", F.when(hit, F.col("new_state")).otherwise(F.col("state"))).drop("new_state")
