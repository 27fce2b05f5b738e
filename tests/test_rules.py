import json

import pytest
from pyspark.sql import functions as F

from pagewarden.operators import findings, report, robots, rules, vitals
from pagewarden.sources import tables


def test_ids_are_unique(spark):
    catalog = rules.checked(rules.page_rules())
    assert len(catalog) == 23
    with pytest.raises(ValueError):
        rules.register_rule(catalog, catalog[0].rule_id, 1, "meta", "low", F.lit(True), F.lit("x"), "y")


def test_median_drops_what_is_not_finite(spark):
    rows = [("s", "u", 1.0), ("s", "u", float("nan")), ("s", "u", 4.0), ("s", "v", None)]
    d = spark.createDataFrame(rows, "site string, url string, lcp_ms double").withColumn("cls_unitless", F.col("lcp_ms")).withColumn("tbt_ms", F.col("lcp_ms"))
    got = {r["url"]: (r["lcp_ms"], r["runs_completed"]) for r in vitals.lab_vitals(d).collect()}
    assert got == {"u": (2.5, 3), "v": (None, 1)}


def test_field_payloads(spark):
    body = '{"loadingExperience":{"metrics":{"LARGEST_CONTENTFUL_PAINT_MS":{"percentile":%s},"CUMULATIVE_LAYOUT_SHIFT_SCORE":{"percentile":20}}}}'
    d = spark.createDataFrame([("s", "a", body % "2353"), ("s", "b", body % '"2353"'), ("s", "c", "{}"), ("s", "d", "broken")], "site string, url string, payload string")
    got = {r["url"]: (r["field_lcp_ms"], r["field_cls"], r["field_inp_ms"]) for r in vitals.field_vitals(d).collect()}
    assert got == {"a": (2353.0, 0.2, None), "b": (None, 0.2, None)}


def test_regressions(spark):
    cur = spark.createDataFrame([("s", "k1", "open", 1), ("s", "k2", "open", 2), ("s", "k3", "acknowledged", 3), ("s", "k2", "open", 4)], "site string, finding_key string, status string, id long")
    base = spark.createDataFrame([("s", "k1")], "site string, finding_key string")
    got = {(r["finding_key"], r["kind"], r["occurrences"]) for r in findings.classify_regressions(cur, base).collect()}
    assert got == {("k2", "regression", 2), ("k3", "intended", 1)}


@pytest.mark.parametrize(("pattern", "path", "hit"), [("/a.b", "/a.b", True), ("/a.b", "/axb", False), ("/a*c", "/abbc/d", True), ("/a$", "/a", True), ("/a$", "/ab", False), ("/p?q=(1)", "/p?q=(1)", True)])
def test_robots_patterns(spark, pattern, path, hit):
    assert spark.range(1).select(F.rlike(F.lit(path), robots.pattern_regex(F.lit(pattern)))).first()[0] is hit


def test_robots_states_and_groups(spark):
    body = "User-agent: A\nUser-agent: B\nDisallow: /x\nAllow: /x/y\n\nUser-agent: *\nDisallow:\n"
    docs = spark.createDataFrame([("s", 200, body), ("t", 404, None), ("u", None, None)], "site string, status_code int, body string").withColumn("state", robots.robots_state(F.col("status_code")))
    rr = robots.robots_rules(docs)
    asked = spark.createDataFrame([(s, f"https://h{p}") for s in "stu" for p in ("/x", "/x/y", "/z")], "site string, url string")
    got = lambda ua: {(r["site"], r["url"][9:]): r["allowed"] for r in robots.url_allowed(asked, rr, docs, ua).collect()}
    b = got("b")
    assert (b["s", "/x"], b["s", "/x/y"], b["s", "/z"], b["t", "/x"], b["u", "/x"]) == (False, True, True, True, False)
    assert all(v for (s, _), v in got("other").items() if s == "s")
    assert {r["site"] for r in robots.ai_bot_access(docs, rr, robots.bot_catalog(spark)).select("site").collect()} == {"s", "t"}


def test_oversized_robots_files_are_unavailable(spark):
    fits = "#" * (robots.BODY_CAP - 26) + "\nUser-agent: *\nDisallow: /"
    rows = [("fits", 200, fits[: robots.BODY_CAP]), ("over", 200, fits + " " * robots.BODY_CAP), ("gone", 404, "x" * (robots.BODY_CAP + 1)), ("wide", 200, "é" * (robots.BODY_CAP // 2 + 1))]
    docs = tables.robots_docs(spark.createDataFrame(rows, "site string, status_code int, body string"))
    assert {r["site"]: r["state"] for r in docs.collect()} == {"fits": "found", "over": "unavailable", "gone": "unavailable", "wide": "unavailable"}
    asked = spark.createDataFrame([(s, "https://h/x") for s, _, _ in rows], "site string, url string")
    assert not any(r["allowed"] for r in robots.url_allowed(asked, robots.robots_rules(docs), docs, "any").collect())
    assert {r["site"] for r in robots.ai_bot_access(docs, robots.robots_rules(docs), robots.bot_catalog(spark)).collect()} == {"fits"}


def test_tables_are_appended_scanned_and_replaced(spark, tmp_path):
    path = str(tmp_path)
    runs = tables.open_runs(spark.createDataFrame([(1,), (2,)], "project_id long"), F.lit("2024-01-01 00:00:00").cast("timestamp"), "raw")
    tables.append(runs.filter("project_id = 1"), path, "audit_run", ("project_id",))
    tables.append(runs.filter("project_id = 2"), path, "audit_run", ("project_id",))
    one = tables.scan(spark, path, "audit_run", F.col("project_id") == 1)
    assert "PartitionFilters: [isnotnull(project_id" in one._jdf.queryExecution().toString()
    ended = [(r["id"], r["project_id"], r["started_at"], r["started_at"], None, "raw") for r in one.collect()]
    closed = spark.createDataFrame(ended, "id long, project_id long, started_at timestamp, finished_at timestamp, score double, render_source string")
    tables.overwrite_partitions(closed, path, "audit_run", ("project_id",))
    got = {r["project_id"]: (r["finished_at"] is not None, r["score"], r["render_source"]) for r in tables.scan(spark, path, "audit_run").collect()}
    assert got == {1: (True, None, "raw"), 2: (False, None, "raw")}


def test_values_outside_of_an_enumeration_fail(spark):
    df = spark.createDataFrame([("low", "meta", "open"), (None, None, None)], "severity string, category string, status string")
    assert tables.checked_findings(df).count() == 2
    with pytest.raises(Exception, match="outside the enumeration: shut"):
        tables.checked_findings(df.withColumn("status", F.lit("shut"))).collect()


def test_reports_are_written_in_parts_and_read_whole(spark, tmp_path):
    pages = [("s", "A", i, f"https://s/{i}", 200, 1234.5 if i == 1 else None, None, None, None, 0.0125 if i == 2 else None, None) for i in range(1, 6)]
    pages = spark.createDataFrame(pages, "site string, run_id string, ord long, url string, status_code int, lcp_ms double, cls_unitless double, tbt_ms double, field_lcp_ms double, field_cls double, field_inp_ms double")
    found = [("s", "A", "https://s/2", r, 1, "meta", sev, cur, "do it", k) for k, (r, sev, cur) in enumerate([("R-A", "low", "x|y\nz"), ("R-B", "critical", None)])]
    found = spark.createDataFrame(found, "site string, run_id string, url string, rule_id string, rule_version int, category string, severity string, current_value string, recommended_value string, rule_ord int")
    search = spark.createDataFrame([("s", 3, 4, 2.25, None)], "site string, clicks long, impressions long, position double, error string")
    traffic = spark.createDataFrame([("s", None, None, "no right")], "site string, sessions double, active_users double, error string")
    summary = findings.severity_summary(found, pages.unionByName(spark.createDataFrame([("empty", "A", *[None] * 9)], pages.schema)))
    rows, heads = report.report_pages(pages, found), report.report_heads(summary, search, traffic)
    for name, parts in (("json", report.to_json_report(rows, heads, "now")), ("md", report.to_markdown(rows, heads, "now"))):
        report.write_reports(parts, f"{tmp_path}/{name}", 3)

    def read(name, site):
        return "\n".join(x.read_text().rstrip("\n") for x in sorted((tmp_path / name / f"site={site}" / "run_id=A").glob("part-*")))

    j = json.loads(read("json", "s"))
    assert [p["url"] for p in j["pages"]] == [f"https://s/{i}" for i in range(1, 6)] and j["search"] == {"clicks": 3, "impressions": 4, "position": 2.25} and j["traffic"] is None and j["traffic_error"] == "no right"
    assert [v["rule_id"] for v in j["pages"][1]["violations"]] == ["R-B", "R-A"] and j["pages"][0]["cwv"]["lcp_ms"] == 1234.5 and j["pages"][0]["field_data"] is None and j["pages"][1]["field_data"]["note"]
    assert (j["overall_label"], j["summary"]["total_pages"], j["summary"]["total_violations"], j["summary"]["by_severity"]["critical"]) == ("danger", 5, 2, 1)
    assert json.loads(read("json", "empty"))["pages"] == []
    m = read("md", "s")
    assert "| danger | 5 | 1 | 0 | 0 | 1 | now |" in m and "Searches (29 days): clicks 3, impressions 4, mean position 2.3" in m and "Visits could not be read: no right" in m
    assert "* critical `R-B`, meta: - -> do it\n* low `R-A`, meta: x\\|y z -> do it" in m and "LCP 1235 ms, CLS unknown, TBT unknown" in m and "CLS 0.013" in m
    assert m.index("https://s/1") < m.index("https://s/5") < m.index("only read pages") and "No page could be looked at" in read("md", "empty")
