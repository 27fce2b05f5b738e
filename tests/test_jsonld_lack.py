"""agg6 judges pages by what they hold, not by the formula that made them."""

import duckdb
from test_oracles import SF, plain

import __spark_entry__ as entry

NAME = "agg6_all_pages_lack_jsonld"


def test_pages_without_head_hold_no_jsonld(spark, tmp_path):
    head = lambda i: "" if i % 2 else "<head><title>t</title></head>"
    rows = [(i, f"https://{'ab'[i % 2]}.example/{i}", f"<html>{head(i)}<body><h1>h</h1><footer>f</footer></body></html>") for i in range(1, 17)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["site"]: r["every"] for r in entry.queries()[NAME](spark, str(tmp_path)).collect()}
    assert got == {"https://a.example": False, "https://b.example": True}


def test_query_equals_sql(spark):
    c = duckdb.connect()
    for t in ("events", "pages"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = c.execute(entry.oracle_sql()[NAME])
    columns = [x[0] for x in want.description]
    df = entry.queries()[NAME](spark, SF)
    assert plain([tuple(r) for r in df.collect()], df.columns) == plain(want.fetchall(), columns)
