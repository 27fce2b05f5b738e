"""Sitemap documents: what counts as a location, what is malformed, and that time is linear."""

import time

import pytest

from pagewarden.operators import sitemap, sitemap_xml

U = "https://s.test/"


def entry(inner, name="url"):
    return f"<{name}>{inner}</{name}>"


def urlset(*entries):
    return "<urlset>" + "".join(entries) + "</urlset>"


@pytest.mark.parametrize(
    ("inner", "want"),
    [
        (f"<loc>{U}a</loc>", f"{U}a"), (f"<loc>\n {U}a\t</loc><lastmod>2024-01-01</lastmod>", f"{U}a"), (f"<loc><![CDATA[{U}?a=1&b=<2>]]></loc>", f"{U}?a=1&b=<2>"), (f"<loc> {U}<![CDATA[x ]]> y </loc>", f"{U}x y"),
        (f"<loc>{U}?a=1&amp;b=2</loc>", f"{U}?a=1&amp;b=2"), (f"<loc>{U}?a&b</loc>", f"{U}?a&b"), (f"<loc>{U}<!-- not this -->b</loc>", f"{U}b"), (f"<!--<loc>{U}old</loc>--><loc>{U}new</loc>", f"{U}new"),
        ("<loc>12345</loc>", None), ("<loc>-1.5e3</loc>", None), ("<loc>0x1F</loc>", None), ("<loc>true</loc>", None), ("<loc>1.2.3</loc>", "1.2.3"), ("<loc> </loc>", None), ("<loc/>", None), ("<loc></loc>", None),
        (f"<loc>{U}a</loc><loc>{U}b</loc>", None), (f"<loc>{U}<b>x</b></loc>", None), (f"<x><loc>{U}deep</loc></x>", None), (f"<image:image><image:loc>{U}i.png</image:loc></image:image><loc>{U}a</loc>", f"{U}a"),
        (f"<sm:loc>{U}a</sm:loc>", None), (f"<LOC>{U}a</LOC>", None), (f"<loc lang='a>b' x=\"/>\">{U}a</loc>", f"{U}a"), (f"<loc>{U}a</loc><xhtml:link rel='alternate' href='{U}de'/>", f"{U}a"), (f"<loc>{U}grün</loc>", f"{U}grün"),
    ],
)
def test_locations(inner, want):
    assert sitemap_xml.locations(urlset(entry(inner), entry(f"<loc>{U}last</loc>"))) == ("urlset", [*([want] if want else []), f"{U}last"])


def test_roots():
    one = f"<loc>{U}a</loc>"
    assert sitemap_xml.locations(f"<?xml version='1.0'?>\n<!DOCTYPE x [<!ENTITY a '>'>]>\n<!-- c --><sitemapindex xmlns='x'>{entry(one, 'sitemap')}{entry(one)}</sitemapindex>\n<!-- end -->") == ("index", [f"{U}a"])
    assert sitemap_xml.locations(f"{urlset(entry(one))}<sitemapindex>{entry(one, 'sitemap')}</sitemapindex>")[0] == "index"
    assert sitemap_xml.locations(f"<sitemapindex/>{urlset(entry(one))}") == ("urlset", [f"{U}a"])
    assert sitemap_xml.locations(f"<sm:urlset xmlns:sm='x'>{entry(one)}</sm:urlset>") == sitemap_xml.locations(f"<html>{urlset(entry(one))}</html>") == sitemap_xml.locations("") == (None, [])


@pytest.mark.parametrize("bad", ["<urlset><url><loc>unterminated", "{}<", "{}<!-- open", "{}<![CDATA[ open", "{}<?open", "{}</urlset>", "<a>{}", "{}<!DOCTYPE", "{}<a b='></a>", "<urlset><url><loc>x</url></loc></urlset>", "{}< a></a>", "{}" + "<a>" * 21 + "</a>" * 21])
def test_malformed_documents_have_no_locations(bad):
    assert sitemap_xml.locations(bad.format(urlset(entry(f"<loc>{U}a</loc>")))) == (None, [])


@pytest.mark.parametrize("unit", ["<a ", "<", "<!--", "<a b='", "<![CDATA[", "<a>", "x", "<a b=\"c\" ", "<loc>"])
def test_a_megabyte_of_anything_is_one_pass(unit):
    began = time.time()
    assert sitemap_xml.locations(urlset(entry(unit * (1_000_000 // len(unit))))) in ((None, []), ("urlset", []))
    assert time.time() - began < 3


def test_documents_as_rows(spark, monkeypatch):
    body = urlset(*(entry(f"<loc>{U}{i}</loc>") for i in range(25_000)))
    rows = [("s", "a", 200, body), ("s", "b", 404, body), ("s", "c", 200, None), ("s", "d", 200, ""), ("s", "e", 200, body + " " * (sitemap_xml.MAX_BYTES - len(body))), ("s", "f", 200, body + " " * (sitemap_xml.MAX_BYTES - len(body) + 1)), ("s", "g", None, body), (None, "h", 200, urlset(entry("<loc>x</loc>"), entry("<loc>x</loc>")))]
    docs = spark.createDataFrame(rows, "site string, sitemap_url string, status_code int, body string")
    got = sitemap.sitemap_entries(docs).groupBy("sitemap_url").agg({"ord": "max", "loc": "count"}).collect()
    assert {r["sitemap_url"]: (r["max(ord)"], r["count(loc)"]) for r in got} == {"a": (24_999, 25_000), "e": (24_999, 25_000), "h": (1, 2)}
    assert sitemap.sitemap_entries(docs.limit(0)).count() == 0
