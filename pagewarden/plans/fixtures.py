"""Input tables of the site operators, derived from the pages and events tables by fixed formulas of page_id.

`shift` moves the formulas: run A is shift 0, run B shift 1, so two runs of the same pages differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.urls import url_origin
from ..operators import vitals
from ..operators.html import extract_signals

AS_OF = "2024-01-30"


def load(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def pages(spark: SparkSession, d: str, shift: int = 0) -> DataFrame:
    p = load(spark, d, "pages").select("page_id", "url", "html").withColumn("site", url_origin(F.col("url")))
    return p.withColumn("k", F.col("page_id") + shift)


def status(k: Column) -> Column:
    return F.when(k % 23 == 5, 404).when(k % 29 == 7, 503).when(k % 31 == 3, 301).otherwise(200)


def _html(k: Column, rendered: bool) -> Column:
    yes = lambda cond, text: F.when(cond, text).otherwise("")
    tag = lambda a, c, v: F.concat(F.lit(f'<meta {a}="{c}" content="'), v, F.lit('">'))
    name = F.concat(F.lit("Article "), k.cast("string"))
    ld = lambda *parts: F.concat(F.lit('<script type="application/ld+json">'), *[x if isinstance(x, Column) else F.lit(x) for x in parts], F.lit("</script>"))
    product = '{"@context":"https://schema.org","@type":"Product","name":"'
    block = (
        F.when(k % 8 == 1, ld('{"@context":"https://schema.org","@type":"WebPage"}'))
        .when(k % 8 == 2, ld('{"@context":"https://schema.org","@graph":[{"@type":["FAQPage","WebPage"]}]}'))
        .when(k % 8 == 3, ld('{"@context":"https://schema.org","@type":'))
        .when(k % 8 == 4, ld('{"@type":"WebPage"}'))
        .when(k % 8 == 5, ld(product, name, '","offers":{},"review":null}'))
        .when(k % 8 == 6, ld(product, name, '"}'))
        .when(k % 8 == 7, ld(product, "no such thing here", '","offers":{}}'))
        .otherwise("")
    )
    head = F.concat(
        yes((k % 3 == 1) | ((k % 3 == 2) & F.lit(rendered)), F.concat(F.lit('<link rel="Canonical" href="'), F.col("url"), F.lit('">'))),
        yes(((k % 7 == 0) & F.lit(rendered)) | (k % 14 == 0), tag("name", "ROBOTS", F.lit("NoIndex"))),
        yes(k % 2 == 0, tag("property", "og:title", name)), yes(k % 5 != 0, tag("property", "og:url", F.col("url"))), yes(k % 3 == 0, tag("property", "og:description", name)),
        yes(k % 4 != 0, tag("name", "description", name)), block,
    )
    extra = F.concat(F.lit("<p>"), name, F.lit("</p>"), yes(k % 9 == 0, F.lit("<h1>Second</h1>")), F.repeat(F.lit('<img src="x.png">'), (k % 6).cast("int")))
    h = F.col("html")
    h = F.when((k % 22 == 0) | ((k % 11 == 0) & F.lit(not rendered)), F.regexp_replace(h, "(?s)<title>.*?</title>", "")).otherwise(h)
    h = F.when(k % 13 == 0, F.regexp_replace(h, "(?s)<h1>.*?</h1>", "")).otherwise(h)
    return F.replace(F.replace(h, F.lit("<head>"), F.concat(F.lit("<head>"), head)), F.lit("<footer>"), F.concat(extra, F.lit("<footer>")))


def crawl_snapshot(spark: SparkSession, d: str, shift: int = 0) -> DataFrame:
    k = F.col("k")
    hops = F.transform(F.when(k % 4 > 0, F.sequence(F.lit(1).cast("long"), k % 4)).otherwise(F.array().cast("array<long>")), lambda i: F.concat(F.col("url"), F.lit("/hop"), i.cast("string")))
    return pages(spark, d, shift).select(
        "site", F.lit("AB"[shift]).alias("run_id"), "page_id", "k", "url", (k % 4).cast("int").alias("depth"), status(k).alias("status_code"), _html(k, False).alias("html"), _html(k, True).alias("rendered_html"),
        F.col("url").alias("final_url"), hops.alias("redirect_chain"),
    )


def numbered_events(spark: SparkSession, d: str) -> DataFrame:
    """Events with the page that their number falls on."""
    n = load(spark, d, "pages").agg(F.count(F.lit(1)).alias("n_pages"))
    e = load(spark, d, "events").crossJoin(F.broadcast(n)).withColumn("page_id", F.col("event_id") % F.col("n_pages"))
    return e.join(pages(spark, d).select("page_id", "site", "url"), "page_id")


def lab_runs(spark: SparkSession, d: str) -> DataFrame:
    ok = F.col("event_type") != "error"
    return numbered_events(spark, d).select("site", "url", (F.col("event_id") % 3).cast("int").alias("run"), F.when(ok, F.col("value") * 20).alias("lcp_ms"), F.when(ok, F.col("value") / 1000).alias("cls_unitless"), F.when(ok, F.col("value")).alias("tbt_ms"))


def field_payloads(spark: SparkSession, d: str) -> DataFrame:
    e = numbered_events(spark, d)
    whole = F.floor("value").cast("long").cast("string")
    first = F.when(F.col("event_id") % 10 == 0, F.concat(F.lit('"'), whole, F.lit('"'))).otherwise(whole)
    metrics = F.concat(F.lit('{"loadingExperience":{"metrics":{"LARGEST_CONTENTFUL_PAINT_MS":{"percentile":'), first, F.lit('},"CUMULATIVE_LAYOUT_SHIFT_SCORE":{"percentile":'), whole, F.lit('},"INTERACTION_TO_NEXT_PAINT":{"percentile":'), whole, F.lit("}}}}"))
    return e.select("site", "url", "event_id", F.when(F.col("event_id") % 17 == 0, '{"loadingExperience":{}}').otherwise(metrics).alias("payload"))


def search_daily(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events")
    return e.groupBy(F.to_date("ts").alias("date")).agg(F.count_if(F.col("event_type") == "click").alias("clicks"), F.count_if(F.col("event_type") == "view").alias("impressions"), F.avg("event_id").alias("position"))


def traffic_daily(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events")
    g = e.groupBy(F.to_date("ts").alias("date")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("u"))
    return g.select("date", F.when(F.dayofmonth("date") % 10 == 0, "n/a").otherwise(F.col("n").cast("string")).alias("sessions"), F.col("u").cast("string").alias("active_users"))


def sites(spark: SparkSession, d: str) -> DataFrame:
    """(site, rank from 0 in order of the name). The table has a row for each site."""
    return pages(spark, d).select("site").distinct().withColumn("rank", F.row_number().over(Window.orderBy("site")) - 1)


# Bodies of the derived robots.txt files, by rank % 5.
ROBOTS = [
    (404, None),
    (503, None),
    (200, "# all\nUser-agent: *\nDisallow: /en/\n"),
    (200, "User-agent: GPTBot\nDisallow: /\n\nUser-agent: *\nAllow: /\nCrawl-delay: 2\nSitemap: https://maps.example/sitemap.xml\n"),
    (200, "User-agent: *\nDisallow: /\nAllow: /fr/\n"),
]


def robots_doc(spark: SparkSession, d: str) -> DataFrame:
    pick = lambda i, kind: F.coalesce(*[F.when(F.col("rank") % 5 == n, F.lit(r[i]).cast(kind)) for n, r in enumerate(ROBOTS)])
    return sites(spark, d).select("site", "rank", pick(0, "int").alias("status_code"), pick(1, "string").alias("body"))


def sitemap_doc(spark: SparkSession, d: str) -> DataFrame:
    """A urlset of the pages with page_id % 4 <> 0; an index of two halves where rank is even; nothing where rank % 7 = 0."""
    p = pages(spark, d).filter("page_id % 4 <> 0").join(sites(spark, d), "site").filter("rank % 7 <> 0")
    half = F.when(F.col("rank") % 2 == 0, F.concat(F.lit("/part"), (F.col("page_id") % 2).cast("string"), F.lit(".xml"))).otherwise("/sitemap.xml")
    entry = F.struct("page_id", F.concat(F.lit("<url><loc>"), F.col("url"), F.lit("</loc></url>")).alias("x"))
    sets = p.groupBy("site", half.alias("name")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["x"]), "").alias("x"))
    sets = sets.select("site", F.concat("site", "name").alias("sitemap_url"), F.lit(200).alias("status_code"), F.concat(F.lit("<urlset>"), "x", F.lit("</urlset>")).alias("body"))
    child = lambda n: F.concat(F.lit("<sitemap><loc>"), F.col("site"), F.lit(f"/part{n}.xml</loc></sitemap>"))
    index = sites(spark, d).filter("rank % 2 = 0 and rank % 7 <> 0").select("site", F.concat("site", F.lit("/sitemap.xml")).alias("sitemap_url"), F.lit(200).alias("status_code"), F.concat(F.lit("<sitemapindex>"), child(0), child(1), F.lit("</sitemapindex>")).alias("body"))
    return sets.unionByName(index)


def ranked_pages(spark: SparkSession, d: str) -> DataFrame:
    return pages(spark, d).withColumn("n", F.row_number().over(Window.partitionBy("site").orderBy("page_id")))


def edges(spark: SparkSession, d: str) -> DataFrame:
    """Per site, pages numbered by page_id: n links to 2n, 2n + 1 and n - 3."""
    p = ranked_pages(spark, d).select("site", "url", "n")
    out = p.select("site", "url", F.posexplode(F.array(F.col("n") * 2, F.col("n") * 2 + 1, F.col("n") - 3)).alias("pos", "to"))
    return out.join(p.select("site", F.col("url").alias("link"), F.col("n").alias("to")), ["site", "to"]).select("site", "url", "pos", "link")


def field_by_page(spark: SparkSession, d: str) -> DataFrame:
    """(site, url) with the largest of each field metric of its payloads."""
    return vitals.field_vitals(field_payloads(spark, d)).groupBy("site", "url").agg(*(F.max(c).alias(c) for c in ("field_lcp_ms", "field_cls", "field_inp_ms")))


def context(spark: SparkSession, d: str, shift: int = 0, lab: bool = True) -> DataFrame:
    """Page context: signals of both texts, parsed JSON-LD, vitals of entry pages."""
    s = extract_signals(crawl_snapshot(spark, d, shift), {"html": "raw", "rendered_html": "rendered"}, {"rendered": "jsonld"})
    if not lab:
        return s.select("*", *[F.lit(None).cast("double").alias(c) for c in ("lcp_ms", "cls_unitless", "tbt_ms")])
    return vitals.attach_vitals(s, vitals.lab_vitals(lab_runs(spark, d)))


# Rules with wildcards, for all agents; which of the two lists a site has goes by its rank.
WILD = [
    [("disallow", "/*?"), ("allow", "/*?page="), ("disallow", "/*.html$"), ("allow", "/en/*-*.html$"), ("disallow", "/*a*a*a*a*a*a*a*a*a*a*a*a*a*a*a*a*a*a*a*a*b"), ("disallow", "/*/*e*/*")],
    [("disallow", "/"), ("allow", "/*e*e*"), ("disallow", "/*/*n*g$"), ("allow", "/$"), ("allow", "*.html"), ("disallow", "/fr/***r*r"), ("allow", "/de/$"), ("disallow", "/*#")],
]


def wild_robots_doc(spark: SparkSession, d: str) -> DataFrame:
    """A robots.txt with wildcards for every site."""
    body = ["User-agent: *\n" + "".join(f"{k}: {p}\n" for k, p in w) for w in WILD]
    return sites(spark, d).select("site", F.lit(200).alias("status_code"), F.when(F.col("rank") % 2 == 0, body[0]).otherwise(body[1]).alias("body"))


def odd_sitemap_doc(spark: SparkSession, d: str) -> DataFrame:
    """A document for each page that lists its URL once, in one of the ways that XML allows, by page_id % 8."""
    u = F.col("url")
    forms = {
        0: ("<urlset><url><loc><![CDATA[", u, "]]></loc></url></urlset>"), 1: ("<urlset><!-- <url><loc>http://old.example/</loc></url> --><url><loc>\n ", u, " </loc></url></urlset>"),
        2: ("<sm:urlset xmlns:sm='x'><sm:url><sm:loc>", u, "</sm:loc></sm:url></sm:urlset>"), 3: ("<urlset><url><image:image><image:loc>http://old.example/</image:loc></image:image><loc>", u, "</loc></url></urlset>"),
        4: ("<urlset><url><loc>", u, "</loc></url>"), 5: ("<?xml version='1.0'?><!DOCTYPE urlset [<!ENTITY a '>'>]><urlset a='>'><url><loc lang='>'>", u, "&amp;x</loc></url></urlset>"),
        6: ("<urlset><url><loc>", u, "</loc><loc>http://old.example/</loc></url></urlset>"), 7: ("<sitemapindex><sitemap><loc>", u, "</loc></sitemap><sitemap><loc>77</loc></sitemap></sitemapindex>"),
    }
    body = F.coalesce(*(F.when(F.col("page_id") % 8 == k, F.concat(F.lit(a), x, F.lit(b))) for k, (a, x, b) in forms.items()))
    return pages(spark, d).select("site", F.concat(F.lit("/"), F.col("page_id").cast("string"), F.lit(".xml")).alias("sitemap_url"), F.lit(200).alias("status_code"), body.alias("body"))


def odd_hosts(spark: SparkSession, d: str) -> DataFrame:
    """(page_id, url): a URL for each page whose host is an address made of page_id in one of its spellings, or a name."""
    k = F.col("page_id")
    n = (k * 7919 + 16777216) % 4294967296
    part = lambda i: F.shiftright(n, 8 * i).bitwiseAND(255)
    text = lambda *xs: F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in xs))
    octal, hexed = (lambda x: F.conv(x.cast("string"), 10, 8)), (lambda x: F.hex(x))
    forms = [
        text(n), text("0x", hexed(n)), text("0", octal(part(3)), ".", part(2), ".", n % 65536), text(part(3), ".0x", hexed(part(2)), ".0", octal(part(1)), ".", part(0)),
        text("[0:00::0:ffff:", hexed(F.shiftright(n, 16)), ":", hexed(n % 65536), "]"), text("B", chr(0xFC), "cher.P", k, ".example"),
    ]
    host = F.coalesce(*(F.when(k % 6 == i, h) for i, h in enumerate(forms)))
    return pages(spark, d).select("page_id", F.concat(F.lit("HTTP://u@"), host, F.lit(":080/a/../b/#f")).alias("url"))


def linked_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages whose HTML holds the links of `edges`, as absolute, rooted and scheme-relative references among others."""
    p = pages(spark, d).select("page_id", "site", "url")
    e = edges(spark, d)
    rest = F.regexp_replace("link", "^[A-Za-z]+://[^/?#]*", "")
    rooted = F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))
    href = F.when(F.col("pos") == 0, F.col("link")).when(F.col("pos") == 1, rooted).otherwise(F.regexp_replace("link", "^[A-Za-z]+:", ""))
    anchor = F.concat(F.lit('<p><a class=x href="'), href, F.lit('">to</a> <a href="mailto:x@y.example">m</a> <a href="http://elsewhere.example/">e</a></p>'))
    bodies = e.groupBy("site", "url").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", anchor.alias("a")))), lambda x: x["a"]), "").alias("body"))
    return p.join(bodies, ["site", "url"], "left").select("page_id", "site", "url", F.concat(F.lit("<html><body>"), F.coalesce("body", F.lit("")), F.lit("</body></html>")).alias("html"))
