"""Large groups are spread: files of a hot site, ranks of a hot site, and levels that shuffle ids."""

import os

from pyspark.sql import functions as F

from pagewarden.operators import linkgraph
from pagewarden.sources import staging, tables


def test_a_hot_site_is_several_files(spark, tmp_path):
    was = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "200k")
    try:
        df = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, F.concat(F.lit("s"), F.col("id") % 20)).otherwise("hot").alias("site"), F.sha2(F.col("id").cast("string"), 256).alias("x")).repartition(8)
        for write in (tables.append, tables.overwrite_partitions):
            name = write.__name__
            write(df, str(tmp_path), name)
            files = {d: sum(f.endswith(".parquet") for f in os.listdir(f"{tmp_path}/{name}/{d}")) for d in os.listdir(f"{tmp_path}/{name}") if d.startswith("site=")}
            assert files["site=hot"] > 3 and sum(v for k, v in files.items() if k != "site=hot") <= 60
            assert spark.read.parquet(f"{tmp_path}/{name}").count() == 60_000
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", was)


def test_ranks_of_groups_of_any_size(spark):
    rows = [("hot" if i % 3 else f"s{i % 5}", (i * 7919) % 1000, i) for i in range(3000)] + [(None, 1, -1), (None, 0, -2)]
    df = spark.createDataFrame(rows, "site string, a int, b int").repartition(7)
    got = {(r["site"], r["a"], r["b"]): r["place"] for r in staging.ranked(df, ["site"], [F.col("a").desc(), F.col("b")]).collect()}
    want = {}
    for site in {r[0] for r in rows}:
        for n, r in enumerate(sorted((x for x in rows if x[0] == site), key=lambda x: (-x[1], x[2])), 1):
            want[r] = n
    assert got == want
    assert staging.ranked(df.limit(0), ["site"], [F.col("a")]).count() == 0


def test_ids_ascend_with_urls(spark):
    urls = spark.createDataFrame([(f"s{i % 3}", f"u{i % 50:02d}") for i in range(400)], "site string, url string").repartition(6)
    got = linkgraph.url_ids(urls).orderBy("site", "url").collect()
    assert len(got) == 150 and [r["id"] for r in got] == sorted({r["id"] for r in got})


def test_a_walk_over_a_planted_graph(spark):
    """A chain, a loop, a dead link, a blocked page, a page that fails, repeated links and sitemap seeds."""
    u = lambda *xs: [f"https://s.test/{x}" for x in xs]
    links = {"a": ["b", "b", "c", "gone"], "b": ["a", "d"], "c": ["e"], "d": ["f"], "e": ["g"], "f": ["h"], "m": ["n"], "x": ["y"], "five": ["z"]}
    edges = [("https://s.test", f"https://s.test/{k}", i, v) for k, vs in links.items() for i, v in enumerate(u(*vs))]
    pages = [("https://s.test", v, 500 if v.endswith("five") else 200) for v in u(*"abcdefghmnxyz", "five")]
    starts = [("https://s.test", u("a")[0], 0, 0), ("https://s.test", u("m")[0] + "#top", 1, 0), ("https://s.test", u("five")[0], 1, 1)]
    got = linkgraph.crawl_reach(
        spark.createDataFrame(edges, "site string, url string, pos int, link string"), spark.createDataFrame(pages, "site string, url string, status_code int"), spark.createDataFrame(starts, "site string, url string, depth int, ord int"),
        spark.createDataFrame([("https://s.test", u("c")[0], False)], "site string, url string, allowed boolean"), max_pages=9,
    ).collect()
    want = [("a", 0, "visited"), ("m", 1, "visited"), ("five", 1, "visited"), ("b", 1, "visited"), ("c", 1, "skipped_by_robots"), ("gone", 1, "missing"), ("n", 2, "visited"), ("d", 2, "visited"), ("f", 3, "visited")]
    assert [(r["url"].removeprefix("https://s.test/"), r["depth"], r["visit_status"]) for r in sorted(got, key=lambda r: r["ord"])] == want
    assert sorted(r["ord"] for r in got) == list(range(1, 10))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_scan_reads_its_partitions_and_columns(spark, tmp_path):
    rows = spark.range(40).selectExpr("concat('s', id % 4) AS site", "'A' AS run_id", "concat('u', id) AS url", "1 AS depth", "200 AS status_code", "'h' AS html", "'r' AS rendered_html", "'f' AS final_url", "array('x') AS redirect_chain")
    tables.append(rows, str(tmp_path), "crawl_snapshot")
    df = tables.scan(spark, str(tmp_path), "crawl_snapshot", (F.col("site") == "s1") & (F.col("status_code") == 200)).select("url", "status_code")
    plan = plan_of(df)
    scan = next(x for x in plan.splitlines() if "FileScan" in x)
    assert "PartitionFilters: [isnotnull(site" in scan and "(site" in scan and "EqualTo(status_code,200)" in scan and "ReadSchema: struct<url:string,status_code:int>" in scan
    assert df.count() == 10


def test_joins_of_bucketed_tables_shuffle_nothing(spark, tmp_path):
    from pagewarden.operators import vitals

    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pages = spark.range(500).selectExpr("concat('s', id % 3) AS site", "concat('u', id) AS url", "cast(id % 2 AS int) AS depth")
        lab = pages.selectExpr("site", "url", "1.0D AS lcp_ms", "0.1D AS cls_unitless", "2.0D AS tbt_ms", "3 AS runs_completed")
        p, v = (tables.save_bucketed(df, str(tmp_path), name, buckets=4) for df, name in ((pages, "layout_pages"), (lab, "layout_lab")))
        df = vitals.attach_vitals(p, v)
        assert "Exchange" not in plan_of(df) and "SortMergeJoin" in plan_of(df)
        assert df.filter("lcp_ms = 1.0").count() == 250 and df.count() == 500
        assert sum(f.endswith(".parquet") for f in os.listdir(tmp_path / "layout_lab")) == 4
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
        for t in ("layout_pages", "layout_lab"):
            spark.sql(f"DROP TABLE IF EXISTS {t}")


def test_staged_tables_are_released(spark):
    staging.release(spark)
    df = staging.cut(spark.range(10), "a")
    staging.cut(df.filter("id > 3"), "b")
    assert staging.release(spark) == 2 and staging.release(spark) == 0
