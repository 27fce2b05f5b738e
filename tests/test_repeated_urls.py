"""Tables in which URLs repeat under other page numbers: rows of pages are told apart by their number."""

import duckdb
import pytest
from test_oracles import plain

import __spark_entry__ as entry

HTML = "<html><head><title>t</title></head><body><h1>h</h1><footer>f</footer></body></html>"


@pytest.fixture(scope="module")
def twice(spark, tmp_path_factory):
    """160 pages of one site and one page of each of three others, every URL twice; no site has more than 200 URLs."""
    d = tmp_path_factory.mktemp("twice")
    urls = [f"https://{x}.example/{x}" for x in "abc"] + [f"https://d.example/p{i}" for i in range(157)]
    rows = [(i + k * 161, u, HTML) for k in (0, 1) for i, u in enumerate(urls)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{d}/pages.parquet")
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").write.parquet(f"{d}/events.parquet")
    c = duckdb.connect()
    for t in ("events", "pages"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet/*.parquet'")
    return str(d), c


@pytest.mark.parametrize("name", ["join9_page_values", "rem4_js_canonical", "join10_open_requests", "agg11b_request_lines", "agg8_report", "agg6_all_pages_lack_jsonld", "grf5_page_links"])
def test_query_equals_sql(spark, twice, name):
    d, c = twice
    df = entry.queries()[name](spark, d)
    got = c.execute(entry.oracle_sql()[name])
    columns = [x[0] for x in got.description]
    assert plain([tuple(r) for r in df.collect()], df.columns) == plain(got.fetchall(), columns)
