"""Queries of the site operators against their SQL, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
NAMES = ["url1_normalize", "url4_resolve", "url5_safe", "sig_signals", "r05_jsonld_invalid", "r08_jsonld_product_name_mismatch", "r14_redirect_chain_long", "agg1_lab_vitals", "agg2_severity_counts", "agg7_token_lists", "rob1_rules", "rob2_url_allowed", "grf1_crawl_reach", "grf2_sitemap_urls", "join5_regressions", "join6_sitemap_gap", "rem5_og", "win10_schedule"]


def plain(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    one = lambda v: "~" if v is None else repr(round(float(v), 6)) if isinstance(v, int | float) and not isinstance(v, bool) else str(v)
    return sorted(tuple(one(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for t in ("events", "documents", "pages"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, sql, name):
    df = entry.queries()[name](spark, SF)
    got = sql.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in got.description]
    assert sorted(columns) == sorted(df.columns)
    assert plain([tuple(r) for r in df.collect()], df.columns) == plain(got.fetchall(), columns)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
