"""The rule catalog as columns. All page rules are evaluated in one pass over a page context, without a shuffle.

A page context has site, run_id, url, status_code, redirect_chain, final_url, the signal structs raw and rendered,
`jsonld` (parsed blocks of the rendered page) and the vitals lcp_ms, cls_unitless, tbt_ms.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.jsonld import jsonld_nodes, jsonld_status, jsonld_types
from ..functions.text import fixed, has, trim_all

SEVERITIES = ("critical", "high", "medium", "low")
CATEGORIES = ("canonical", "indexing", "schema", "geo", "meta", "cwv")
# Limits of the vitals.
LCP_MS, CLS, TBT_MS = 2500, 0.1, 150

#: What each rule recommends.
RECOMMENDED = {
    "R-CANONICAL-MISSING": "add a canonical link to the page itself",
    "R-CANONICAL-JS-ONLY": "put the canonical link into the served HTML",
    "R-NOINDEX-DETECTED": "remove noindex if the page should be found",
    "R-JSONLD-MISSING": "describe the page in JSON-LD",
    "R-JSONLD-INVALID": "correct the block",
    "R-QA-STRUCTURE-MISSING": "mark up questions and answers, if there are any",
    "R-JSONLD-PRODUCT-INCOMPLETE": "complete the product",
    "R-JSONLD-PRODUCT-NAME-MISMATCH": "use the product name that the page shows",
    "R-OG-BASIC-MISSING": "add og:title and og:url",
    "R-OG-DESCRIPTION-MISSING": "add og:description",
    "R-META-DESCRIPTION-MISSING": "add a description",
    "R-STATUS-4XX": "restore or redirect the page",
    "R-STATUS-5XX": "repair the server error",
    "R-REDIRECT-CHAIN-LONG": "redirect in one hop",
    "R-RAW-RENDERED-GAP-TITLE": "serve the title in the HTML",
    "R-RAW-RENDERED-GAP-METAROBOTS": "serve the robots directive in the HTML",
    "R-CWV-LCP-POOR": "2500 ms or less",
    "R-CWV-CLS-POOR": "0.1 or less",
    "R-CWV-TBT-POOR": "150 ms or less",
    "R-TITLE-MISSING": "add a title",
    "R-H1-MISSING": "add one h1",
    "R-H1-MULTIPLE": "keep one h1",
    "R-IMG-ALT-MISSING": "give images an alt text",
    "R-AI-CRAWLER-POLICY": "for information: the policy is the site's choice",
    "R-SITEMAP-MISSING-URL": "list the crawled pages",
    "R-JSONLD-WEBSITE-MISSING": "describe the site in JSON-LD",
}


@dataclass(frozen=True)
class Rule:
    rule_id: str
    category: str
    severity: str
    predicate: Column
    current: Column
    recommended: str
    version: int = 1


def severity_rank(c: Column) -> Column:
    return F.coalesce(*[F.when(c == s, i) for i, s in enumerate(SEVERITIES)], F.lit(99))


def page_rules() -> list[Rule]:
    """In registry order, which is the order of equal severities in reports."""
    ok = F.col("status_code") == 200
    raw, ren = (lambda f: F.col(f"raw.{f}")), (lambda f: F.col(f"rendered.{f}"))
    none = F.lit(None).cast("string")
    status = F.col("status_code").cast("string")
    blocks = jsonld_status(F.col("jsonld"))
    bad = F.filter(F.transform(blocks, lambda s, i: F.struct((i + 1).alias("n"), s.alias("s"))), lambda x: x["s"] != "valid")
    first_bad = F.try_element_at(bad, F.lit(1))
    is_a = lambda t: lambda n: F.array_contains(n["types"], t)
    unnamed = lambda n: n["name"].isNull() | (trim_all(n["name"]) == "")
    bare = lambda n: ~(n["has_review"] | n["has_rating"] | n["has_offers"])
    products = F.filter(jsonld_nodes(F.col("jsonld")), is_a("Product"))
    lacking = F.try_element_at(F.filter(products, lambda n: unnamed(n) | bare(n)), F.lit(1))
    lacks = F.concat_ws(", ", F.when(unnamed(lacking), "name"), F.when(bare(lacking), "review/aggregateRating/offers"))
    absent = lambda n: ~unnamed(n) & ~F.contains(F.lower(ren("body_text")), F.lower(trim_all(n["name"])))
    other_name = F.try_element_at(F.filter(products, absent), F.lit(1))
    og = F.concat_ws(", ", F.when(~has(ren("og_title")), "og:title"), F.when(~has(ren("og_url")) & has(ren("canonical")), "og:url"))
    hops = F.concat(F.size("redirect_chain").cast("string"), F.lit(" hops: "), F.array_join(F.concat(F.col("redirect_chain"), F.array("final_url")), " -> "))
    return [
        Rule("R-CANONICAL-MISSING", "canonical", "high", ok & ~has(raw("canonical")) & ~has(ren("canonical")), none, RECOMMENDED["R-CANONICAL-MISSING"]),
        Rule("R-CANONICAL-JS-ONLY", "canonical", "critical", ok & ~has(raw("canonical")) & has(ren("canonical")), ren("canonical"), RECOMMENDED["R-CANONICAL-JS-ONLY"]),
        Rule("R-NOINDEX-DETECTED", "indexing", "medium", ok & F.contains(F.lower(ren("meta_robots")), F.lit("noindex")), ren("meta_robots"), RECOMMENDED["R-NOINDEX-DETECTED"]),
        Rule("R-JSONLD-MISSING", "schema", "low", ok & (F.size(ren("jsonld_blocks")) == 0), none, RECOMMENDED["R-JSONLD-MISSING"]),
        Rule("R-JSONLD-INVALID", "schema", "high", ok & first_bad.isNotNull(), F.concat(F.lit("block "), first_bad["n"].cast("string"), F.lit(": "), first_bad["s"]), RECOMMENDED["R-JSONLD-INVALID"]),
        Rule("R-QA-STRUCTURE-MISSING", "geo", "low", ok & ~F.arrays_overlap(jsonld_types(F.col("jsonld")), F.array(F.lit("FAQPage"), F.lit("QAPage"))), none, RECOMMENDED["R-QA-STRUCTURE-MISSING"]),
        Rule("R-JSONLD-PRODUCT-INCOMPLETE", "schema", "medium", ok & lacking.isNotNull(), lacks, RECOMMENDED["R-JSONLD-PRODUCT-INCOMPLETE"]),
        Rule("R-JSONLD-PRODUCT-NAME-MISMATCH", "schema", "high", ok & has(ren("body_text")) & other_name.isNotNull(), other_name["name"], RECOMMENDED["R-JSONLD-PRODUCT-NAME-MISMATCH"]),
        Rule("R-OG-BASIC-MISSING", "meta", "low", ok & (og != ""), og, RECOMMENDED["R-OG-BASIC-MISSING"]),
        Rule("R-OG-DESCRIPTION-MISSING", "meta", "low", ok & ~has(ren("og_description")), none, RECOMMENDED["R-OG-DESCRIPTION-MISSING"]),
        Rule("R-META-DESCRIPTION-MISSING", "meta", "low", ok & ~has(ren("meta_description")), none, RECOMMENDED["R-META-DESCRIPTION-MISSING"]),
        Rule("R-STATUS-4XX", "indexing", "critical", F.col("status_code").between(400, 499), status, RECOMMENDED["R-STATUS-4XX"]),
        Rule("R-STATUS-5XX", "indexing", "critical", F.col("status_code") >= 500, status, RECOMMENDED["R-STATUS-5XX"]),
        Rule("R-REDIRECT-CHAIN-LONG", "indexing", "medium", F.size("redirect_chain") >= 2, hops, RECOMMENDED["R-REDIRECT-CHAIN-LONG"]),
        Rule("R-RAW-RENDERED-GAP-TITLE", "indexing", "high", ok & ~has(raw("title")) & has(ren("title")), ren("title"), RECOMMENDED["R-RAW-RENDERED-GAP-TITLE"]),
        Rule("R-RAW-RENDERED-GAP-METAROBOTS", "indexing", "high", ok & ~has(raw("meta_robots")) & has(ren("meta_robots")), ren("meta_robots"), RECOMMENDED["R-RAW-RENDERED-GAP-METAROBOTS"]),
        Rule("R-CWV-LCP-POOR", "cwv", "high", F.col("lcp_ms") > LCP_MS, F.concat(F.round("lcp_ms").cast("long").cast("string"), F.lit("ms")), RECOMMENDED["R-CWV-LCP-POOR"]),
        Rule("R-CWV-CLS-POOR", "cwv", "high", F.col("cls_unitless") > CLS, fixed(F.col("cls_unitless"), 3), RECOMMENDED["R-CWV-CLS-POOR"]),
        Rule("R-CWV-TBT-POOR", "cwv", "high", F.col("tbt_ms") > TBT_MS, F.concat(F.round("tbt_ms").cast("long").cast("string"), F.lit("ms")), RECOMMENDED["R-CWV-TBT-POOR"]),
        Rule("R-TITLE-MISSING", "meta", "high", ok & ~has(raw("title")) & ~has(ren("title")), none, RECOMMENDED["R-TITLE-MISSING"]),
        Rule("R-H1-MISSING", "meta", "medium", ok & (ren("h1_count") == 0), none, RECOMMENDED["R-H1-MISSING"]),
        Rule("R-H1-MULTIPLE", "meta", "low", ok & (ren("h1_count") > 1), ren("h1_count").cast("string"), RECOMMENDED["R-H1-MULTIPLE"]),
        Rule("R-IMG-ALT-MISSING", "meta", "low", ok & (ren("images_without_alt") > 0), ren("images_without_alt").cast("string"), RECOMMENDED["R-IMG-ALT-MISSING"]),
    ]


def checked(rules: list[Rule]) -> list[Rule]:
    ids = [r.rule_id for r in rules]
    if len(set(ids)) < len(ids):
        raise ValueError(f"rule ids repeat: {sorted(x for x in set(ids) if ids.count(x) > 1)}")
    for r in rules:
        if r.severity not in SEVERITIES or r.category not in CATEGORIES:
            raise ValueError(f"{r.rule_id}: unknown severity or category")
    return rules


def register_rule(rules: list[Rule], rule_id: str, version: int, category: str, severity: str, predicate: Column, current: Column, recommended: str) -> list[Rule]:
    """The catalog with one more rule at its end."""
    return checked([*rules, Rule(rule_id, category, severity, predicate, current, recommended, version)])


VIOLATION = ("site", "run_id", "url", "rule_id", "rule_version", "category", "severity", "current_value", "recommended_value", "rule_ord")


def evaluate_rules(context: DataFrame, rules: list[Rule] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """A row for each rule that fires, by one explode of an array of structs. keep: columns of the context to carry."""
    fired = [
        F.when(r.predicate, F.struct(
            F.lit(r.rule_id).alias("rule_id"), F.lit(r.version).alias("rule_version"), F.lit(r.category).alias("category"), F.lit(r.severity).alias("severity"),
            r.current.alias("current_value"), F.lit(r.recommended).alias("recommended_value"), F.lit(i).alias("rule_ord"),
        ))
        for i, r in enumerate(checked(page_rules() if rules is None else rules))
    ]
    own = ("site", "run_id", "url", *keep)
    return context.select(*own, F.explode(F.array_compact(F.array(*fired))).alias("v")).select(*own, "v.*")


def _site_rule(df: DataFrame, rule_id: str, category: str, severity: str, url: Column, current: Column, recommended: str, order: int) -> DataFrame:
    return df.select(
        "site", "run_id", url.alias("url"), F.lit(rule_id).alias("rule_id"), F.lit(1).alias("rule_version"), F.lit(category).alias("category"), F.lit(severity).alias("severity"),
        current.alias("current_value"), F.lit(recommended).alias("recommended_value"), F.lit(order).alias("rule_ord"),
    )


def ai_policy_rule(policy: DataFrame) -> DataFrame:
    """One neutral row for each site whose robots state is known. policy: site, run_id, robots_found, summary."""
    current = F.when(F.col("robots_found"), F.col("summary")).otherwise(F.concat(F.lit("no robots.txt, all allowed; "), F.col("summary")))
    return _site_rule(policy, "R-AI-CRAWLER-POLICY", "geo", "low", F.concat("site", F.lit("/robots.txt")), current, RECOMMENDED["R-AI-CRAWLER-POLICY"], 100)


def sitemap_rule(gap: DataFrame) -> DataFrame:
    """gap: site, run_id, missing (count of crawled paths that the sitemap lacks)."""
    return _site_rule(gap.filter("missing > 0"), "R-SITEMAP-MISSING-URL", "indexing", "medium", F.concat("site", F.lit("/sitemap.xml")), F.col("missing").cast("string"), RECOMMENDED["R-SITEMAP-MISSING-URL"], 101)


def jsonld_lack(pages: DataFrame, violations: DataFrame, by: tuple[str, ...] = ("site", "run_id", "url")) -> DataFrame:
    """(site, run_id, every, n): does every page of status 200 lack JSON-LD, and how many such pages there are.

    by: what tells pages apart, in both tables.
    """
    lacking = violations.filter(F.col("rule_id") == "R-JSONLD-MISSING").select(*by, F.lit(True).alias("lacks")).distinct()
    ok = pages.filter("status_code = 200").select(*by).join(lacking, list(by), "left")
    return ok.groupBy("site", "run_id").agg(F.bool_and(F.coalesce("lacks", F.lit(False))).alias("every"), F.count(F.lit(1)).alias("n"))


def website_rule(pages: DataFrame, violations: DataFrame, by: tuple[str, ...] = ("site", "run_id", "url")) -> DataFrame:
    """Sites with pages of status 200 of which every one lacks JSON-LD."""
    every = jsonld_lack(pages, violations, by).filter("every and n > 0")
    return _site_rule(every, "R-JSONLD-WEBSITE-MISSING", "schema", "low", F.concat("site", F.lit("/")), F.col("n").cast("string"), RECOMMENDED["R-JSONLD-WEBSITE-MISSING"], 102)
