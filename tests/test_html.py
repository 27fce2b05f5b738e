import time

import pytest

from pagewarden.functions.jsonld import nodes_of
from pagewarden.operators.html import signals_of


def test_signals():
    s = signals_of('<html><head><title> A &amp; <b>B</b></title><LINK REL="Canonical" HREF="/c"><meta name="ROBOTS" content="noindex"><meta name="og:title" content="no"><meta property="og:title" content="yes">'
                   '<script type="application/LD+json"> {"a":1} </script><script type="application/ld+json">  </script></head><body><h1> One </h1><h1>Two</h1><img src=a><img src=b alt=""> x\n\n y <A HREF="/l">l</A></body></html>')  # fmt: skip
    assert (s["canonical"], s["h1_count"], s["h1_text"], s["meta_robots"], s["og_title"]) == ("/c", 2, "One", "noindex", "yes")
    assert s["title"].startswith("A & <b>B")
    assert s["jsonld_blocks"] == ['{"a":1}'] and s["images_without_alt"] == 1 and s["links"] == ["/l"] and s["body_text"].endswith("x y l")


@pytest.mark.parametrize("page", [None, "", "<"])
def test_nothing(page):
    s = signals_of(page)
    assert s["title"] is None and s["h1_count"] == 0 and s["jsonld_blocks"] == [] and s["body_text"] == ""


@pytest.mark.parametrize(("block", "status"), [
    ('{"@context":"x","@type":"A"}', "valid"), ('{"@context":{},"@graph":[{"@type":"A"}]}', "valid"), ('{"@context":"","@type":"A"}', "valid"), ('{"@context":"x","@graph":[{"@type":["A"]}]}', "valid"), ('[{"@context":"x","@type":"A"}]', "valid"),
    ("{", "malformed_json"), ('{"a":1} t', "malformed_json"), ("[1]", "not_object"), ('{"name":"x"}', "missing_context_or_type"), ('{"@context":"x","@graph":[null]}', "missing_context_or_type"), ('{"a":NaN}', "malformed_json"),
])
def test_jsonld(block, status):
    assert nodes_of(block)[0] == status


@pytest.mark.parametrize(
    ("page", "key", "want"),
    [
        ("<link rel=canonical><link rel=canonical href=/b>", "canonical", None), ("<link rel=icon href=/i><link rel=CANONICAL href='/b c'>", "canonical", "/b c"), ("<link rel=canonical href><link rel=canonical href=/b>", "canonical", ""),
        ("<meta name=robots><meta name=robots content=noindex>", "meta_robots", None), ("<meta name=Robots content=a><meta name=robots content=b>", "meta_robots", "a"), ("<meta content=x name=description property='og:title'>", "og_title", "x"),
        ("<meta property=og:url><meta property=og:url content=u>", "og_url", None), ("<meta name=description content='a &amp; b'>", "meta_description", "a & b"), ("<meta property=og:description content=d>", "og_description", "d"),
        ("<title>a</title><title>b</title>", "title", "a"), ("<title>a<!-- b --><i>", "title", "a<!-- b --><i>"), ("<title></title>", "title", ""), ("<p>x", "title", None), ("<!-- <title>no</title> --><title>y</title>", "title", "y"),
        ("<a href=x title='>'>t</a><a b=\"'\" href='y'>", "links", ["x", "y"]), ("<a href=one><a href='open>", "links", ["one"]), ("<p don't><a href=z>", "links", ["z"]), ("<a href=/p/?a=1&amp;b>", "links", ["/p/?a=1&b"]), ("< a href=x><a\nhref=y/>", "links", ["y/"]),
        ("<body>a<script>if (a < b) '</p>'</script>b</body>", "body_text", "aif (a < b) '</p>'b"), ("<body>1 < 2 &lt; 3</body>", "body_text", "1 < 2 < 3"), ("<body>a<!-->b-->c<!--->d<!-- e --!> f -->g", "body_text", "ab-->cdg"), ("<body>x</ y>z<!doctype a>w<?pi?>v", "body_text", "xzwv"),
        ("<h1>a<b>b</b></h1><h1>c</h1>", "h1_text", "ab"), ("<script type=application/ld+json>{\"a\":\"&amp;</p>\"}</SCRIPT >", "jsonld_blocks", ['{"a":"&amp;</p>"}']), ("<img><img alt><img alt='' src=x><IMG SRC=y>", "images_without_alt", 2),
    ],
)
def test_tokens(page, key, want):
    assert signals_of(page)[key] == want


@pytest.mark.parametrize("unit", ["<a ", "<", "</", "<!--", "<!", "<a b='", "<a b=\"c\" ", "<title>", "<script>", "<a b=c>", "&amp", "<a/", "<a =", "x"])
def test_a_megabyte_of_anything_is_one_pass(unit):
    began = time.time()
    signals_of("<body>" + unit * (1_000_000 // len(unit)))
    assert time.time() - began < 4


def test_jsonld_in_the_same_pass(spark):
    from pagewarden.functions.jsonld import parse_blocks
    from pagewarden.operators.html import extract_signals

    pages = [(1, '<script type="application/ld+json">{"@context":"x","@type":["A",1],"name":"n"}</script><script type="application/ld+json">{</script>'), (2, None), (3, "<p>")]
    df = spark.createDataFrame(pages, "id int, html string")
    s = extract_signals(df, {"html": "raw"}, {"raw": "jsonld"})
    both = s.select("id", "jsonld", parse_blocks(s["raw.jsonld_blocks"]).alias("apart")).collect()
    assert all(r["jsonld"] == r["apart"] for r in both) and [len(r["jsonld"]) for r in sorted(both)] == [2, 0, 0]
    plan = s.select("jsonld")._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan
