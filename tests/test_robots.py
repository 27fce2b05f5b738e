"""Path rules: wildcards, prefixes, hostile patterns, and the same decisions as by plain Python."""

import random
import re
import time

from pyspark.sql import functions as F

from pagewarden.operators import robots
from pagewarden.sources import tables


def docs_of(spark, bodies):
    return tables.robots_docs(spark.createDataFrame([(f"https://{k}.test", 200, b) for k, b in enumerate(bodies)], "site string, status_code int, body string"))


def decide(rules, path):
    """(allowed) by regular expressions."""
    best = max(((len(p), k == "allow") for k, p in rules if p and re.match(re.escape(p.removesuffix("$")).replace(r"\*", ".*") + "$" * p.endswith("$"), path, re.S)), default=(0, True))
    return best[1]


def allowed(spark, bodies, paths, agent="bot"):
    docs = docs_of(spark, bodies)
    urls = spark.createDataFrame([(f"https://{k}.test", f"https://{k}.test{p}") for k, ps in enumerate(paths) for p in ps], "site string, url string")
    got = robots.url_allowed(urls, robots.robots_rules(docs), docs, agent).collect()
    return {(r["site"], r["url"]): r["allowed"] for r in got}


def test_random_patterns(spark):
    r = random.Random(3)
    bodies, paths, rules = [], [], []
    for _ in range(40):
        own = [(r.choice(["allow", "disallow"]), "/" * (r.random() < 0.9) + "".join(r.choices("ab/**", k=r.randint(0, 7))) + "$" * (r.random() < 0.3)) for _ in range(r.randint(0, 6))]
        rules.append(own)
        bodies.append("User-agent: *\n" + "".join(f"{k}: {p}\n" for k, p in own))
        paths.append(["/" + "".join(r.choices("ab/", k=r.randint(0, 9))) for _ in range(30)])
    got = allowed(spark, bodies, paths)
    for k, ps in enumerate(paths):
        for p in ps:
            assert got[f"https://{k}.test", f"https://{k}.test{p}"] == decide(rules[k], p), (rules[k], p)


def test_fixed_cases(spark):
    body = "User-agent: *\nDisallow: /a*b*c$\nAllow: /abc/*/c$\nDisallow: /x$\nDisallow: /f%c3%bc\nDisallow: /grün\nDisallow: /*.php$\nAllow: /p*.php$"
    cases = {"/abc": False, "/abcc": False, "/abcd": True, "/abc/c": False, "/abc/d/c": True, "/x": False, "/xy": True, "/für": False, "/Für": True, "/gr%C3%BCn": False, "/gr%c3%bcn/x": False, "/a.php": False, "/p.php": True, "/a.php?x": True, "": True}
    got = allowed(spark, [body], [list(cases)])
    assert {p: got["https://0.test", f"https://0.test{p}"] for p in cases} == cases


def test_a_pattern_of_twenty_wildcards_ends(spark):
    path = "/" + "a" * 2000
    bodies = ["User-agent: *\n" + "".join(f"Disallow: /{'*a' * n}*b\n" for n in range(1, 60)), "User-agent: *\nDisallow: /" + "*a" * 20 + "\nAllow: /" + "*a" * 2001]
    docs = docs_of(spark, bodies)
    rules = robots.robots_rules(docs)
    urls = spark.createDataFrame([(f"https://{k}.test", f"https://{k}.test{path}") for k in (0, 1)], "site string, url string")
    began = time.time()
    got = {r["site"]: r["allowed"] for r in robots.url_allowed(urls, rules, docs, "bot").collect()}
    assert got == {"https://0.test": True, "https://1.test": False} and time.time() - began < 30
    one = spark.range(1).select(robots.glob_matches(F.lit(path), F.lit(1), F.array(*[F.lit("a")] * 20, F.lit("b")), F.lit(False)))
    one.collect()
    began = time.time()
    assert not one.first()[0] and time.time() - began < 1


def test_paths_meet_only_rules_with_their_beginning(spark):
    """1,000 rules under 1,000 prefixes and 1,000 URLs: the join makes a row for each URL, not for each pair."""
    docs = docs_of(spark, ["User-agent: *\n" + "".join(f"Disallow: /d{i:04d}/*x\n" for i in range(1000))])
    urls = spark.createDataFrame([("https://0.test", f"https://0.test/d{i:04d}/{'x' * (i % 2)}") for i in range(1000)], "site string, url string")
    rules = robots.robots_rules(docs)
    filed = robots.filed_rules(rules)
    assert filed.count() == 1000 and filed.agg(F.max(F.size("filed"))).first()[0] == 1
    df = robots.url_allowed(urls, rules, docs, "bot")
    assert df.filter("allowed").count() == 500
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan
