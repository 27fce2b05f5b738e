"""Crawls of sites with more URLs than a crawl's usual budget, and of URLs that were fetched more than once."""

import duckdb
import pytest
from test_oracles import plain

import __spark_entry__ as entry
from pagewarden.operators import linkgraph

HTML = "<html><head><title>t</title></head><body><h1>h</h1><footer>f</footer></body></html>"


def test_page_links_are_followed_beyond_200_urls(spark, tmp_path):
    """One page of each of three sites, 320 of a fourth: 240 of them are in its sitemap, more are linked by those."""
    urls = [f"https://{x}.example/{x}" for x in "abc"] + [f"https://d.example/p{i}" for i in range(320)]
    spark.createDataFrame([(i, u, HTML) for i, u in enumerate(urls)], "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    df = entry.queries()["grf5_page_links"](spark, str(tmp_path))
    got = c.execute(entry.oracle_sql()["grf5_page_links"])
    columns, want = [x[0] for x in got.description], got.fetchall()
    assert len(want) > 250
    assert plain([tuple(r) for r in df.collect()], df.columns) == plain(want, columns)


@pytest.mark.parametrize("budget", [1, 7, 30])
def test_a_budget_is_a_beginning_of_the_whole_crawl(spark, budget):
    u = lambda i: f"https://s.test/{i}"
    edges = spark.createDataFrame([("https://s.test", u(i), p, u((i * 3 + p) % 90)) for i in range(90) for p in range(4)], "site string, url string, pos int, link string")
    snapshot = spark.createDataFrame([("https://s.test", u(i), 404 if i % 7 == 6 else 200) for i in range(80)], "site string, url string, status_code int")
    seeds = spark.createDataFrame([("https://s.test", u(1), 0, 0), *(("https://s.test", u(i), 1, i) for i in range(40, 50))], "site string, url string, depth int, ord int")
    whole, cut = (sorted(map(tuple, linkgraph.crawl_reach(edges, snapshot, seeds, max_pages=n).collect()), key=lambda r: r[3]) for n in (None, budget))
    assert len(whole) > 30 and [r[3] for r in whole] == list(range(1, len(whole) + 1))
    assert cut == whole[:budget]


def test_the_first_fetch_of_a_url_counts(spark):
    edges = spark.createDataFrame([("https://s.test", "https://s.test/a", 0, "https://s.test/b"), ("https://s.test", "https://s.test/b", 0, "https://s.test/c")], "site string, url string, pos int, link string")
    rows = [("https://s.test", "https://s.test/a", 503, 9), ("https://s.test", "https://s.test/a#x", 200, 1), ("https://s.test", "https://s.test/b", 404, 2), ("https://s.test", "https://s.test/b", 200, 3)]
    snapshot = spark.createDataFrame(rows, "site string, url string, status_code int, page_id long").coalesce(1)
    seeds = spark.createDataFrame([("https://s.test", "https://s.test/a", 0, 0)], "site string, url string, depth int, ord int")
    for max_pages in (None, 200):
        got = linkgraph.crawl_reach(edges, snapshot, seeds, max_pages=max_pages, first="page_id").collect()
        assert sorted((r["url"], r["depth"]) for r in got) == [("https://s.test/a", 0), ("https://s.test/b", 1)]
