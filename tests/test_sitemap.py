"""Sitemaps beyond a crawl's budget: the gap is to all that is listed."""

import duckdb
import pytest
from test_oracles import plain

import __spark_entry__ as entry
from pagewarden.operators import robots, sitemap


@pytest.mark.parametrize("name", ["join6_sitemap_gap", "join6b_proposed_urls", "grf2_sitemap_urls"])
def test_sites_of_more_than_200_listed_pages(spark, tmp_path, name):
    # Sites in order of the name: without a sitemap, with one urlset, with an index of two halves.
    rows = [(i, f"https://{'abc'[i % 3]}.example/en/{i}", f"<html><head><title>t</title></head><body><h1>Article {i}</h1><footer>f</footer></body></html>") for i in range(1200)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    got = c.execute(entry.oracle_sql()[name])
    columns = [x[0] for x in got.description]
    df = entry.queries()[name](spark, str(tmp_path))
    assert plain([tuple(r) for r in df.collect()], df.columns) == plain(got.fetchall(), columns)


def test_all_children_of_an_index(spark):
    loc = lambda kind, xs: "".join(f"<{kind}><loc>{x}</loc></{kind}>" for x in xs)
    docs = [("s", "s/sitemap.xml", 200, f"<sitemapindex>{loc('sitemap', [f's/{i}.xml' for i in range(60)])}</sitemapindex>")]
    docs += [("s", f"s/{i}.xml", 200, f"<urlset>{loc('url', [f'https://s.example/{i}/{j}' for j in range(5)])}</urlset>") for i in range(60)]
    docs = spark.createDataFrame(docs, "site string, sitemap_url string, status_code int, body string")
    roots = spark.createDataFrame([("s", "s/sitemap.xml", 0)], "site string, sitemap_url string, ord int")
    got = [r["url"] for r in sitemap.all_sitemap_urls(docs, roots).orderBy("ord").collect()]
    assert got == [f"https://s.example/{i}/{j}" for i in range(60) for j in range(5)]
    assert sitemap.sitemap_urls(docs, roots).count() == 200


def docs_of(spark, docs):
    return spark.createDataFrame([("s", u, 200, b) for u, b in docs], "site string, sitemap_url string, status_code int, body string")


def index(*children):
    return f"<sitemapindex>{''.join(f'<sitemap><loc>{c}</loc></sitemap>' for c in children)}</sitemapindex>"


def urls(*pages):
    return f"<urlset>{''.join(f'<url><loc>{p}</loc></url>' for p in pages)}</urlset>"


def test_indexes_of_any_depth_and_loops(spark):
    docs = [(f"s/{i}.xml", index(f"s/{i}.xml", f"s/{i + 1}.xml", "s/0.xml")) for i in range(9)] + [("s/9.xml", urls("https://s/a", "https://s/b"))]
    roots = spark.createDataFrame([("s", "s/0.xml", 0)], "site string, sitemap_url string, ord int")
    got = sitemap.sitemap_urls(docs_of(spark, docs), roots).collect()
    assert [(r["ord"], r["url"], r["truncated"]) for r in sorted(got, key=lambda r: r["ord"])] == [(1, "https://s/a", False), (2, "https://s/b", False)]
    assert sitemap.all_sitemap_urls(docs_of(spark, docs), roots).count() == 2


@pytest.mark.parametrize(("budget", "children", "taken", "truncated"), [(4, 50, 4, False), (3, 50, 3, True), (2, 50, 2, True), (9, 1, 2, True), (9, 2, 4, False)])
def test_what_counts_as_truncated(spark, budget, children, taken, truncated):
    docs = [("s/r.xml", index("s/1.xml", "s/2.xml")), ("s/1.xml", urls("https://s/a", "https://s/b")), ("s/2.xml", urls("https://s/c", "https://s/d"))]
    roots = spark.createDataFrame([("s", "s/r.xml", 0)], "site string, sitemap_url string, ord int")
    got = sitemap.sitemap_urls(docs_of(spark, docs), roots, budget, children).collect()
    assert len(got) == taken and {r["truncated"] for r in got} == {truncated}


def test_each_root_has_the_budget_and_ends_at_a_bad_url(spark):
    docs = [("s/1.xml", urls("https://s/a", "no url", "https://s/b")), ("s/2.xml", urls("https://s/c", "https://other/d", "https://s/e"))]
    roots = spark.createDataFrame([("https://s", "s/1.xml", 0), ("https://s", "s/2.xml", 1)], "site string, sitemap_url string, ord int")
    df = docs_of(spark, docs).replace("s", "https://s", "site")
    got = robots.same_origin_seeds(sitemap.sitemap_urls(df, roots, 3)).collect()
    assert {(r["root"], r["url"]) for r in got} == {(0, "https://s/a"), (1, "https://s/c"), (1, "https://s/e")}
