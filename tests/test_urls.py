import pytest
from pyspark.sql import functions as F

from pagewarden.functions import text, urls


def ask(spark, f, values):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").orderBy("i").select(f(F.col("v"))).collect()]


def test_normalize(spark):
    cases = {
        "https://Shop.Garten.test/Beete#tomaten": "https://shop.garten.test/Beete",
        "HTTP://garten.test:80": "http://garten.test/",
        "https://garten.test:443//?q=#x": "https://garten.test/?q=",
        "http://garten.test:443/a?": "http://garten.test:443/a",
        "https://garten.test/x/y/../../z/./w/": "https://garten.test/z/w",
        "https://garten.test/gr\u00fcn beet/?s=\u00e4": "https://garten.test/gr%C3%BCn%20beet?s=%C3%A4",
        "garten.test/beete": None,
        "": None,
    }
    assert ask(spark, urls.normalize_url, list(cases)) == list(cases.values())
    assert ask(spark, urls.frontier_url, ["garten.test/beete"]) == ["garten.test/beete"]


def test_private_addresses(spark):
    """The first and last address of every range that is not public, and their public neighbours."""
    bad = "0.0.0.1 10.255.0.9 100.64.3.3 100.127.255.255 127.8.8.8 169.254.1.1 172.16.9.9 172.31.0.4 192.168.77.1 224.0.0.5 250.1.2.3 :: ::1 fe9a::7 fcab::1 fd12:3456::1 ::ffff:10.9.8.7 ::ffff:192.168.3.4 010.8.8.8 0x7f.1 3232235521 300.1.1.1 garten.test".split()
    good = "9.255.255.255 11.0.0.0 100.63.255.255 100.128.0.0 126.1.1.1 128.0.0.1 169.253.0.1 172.15.1.1 172.32.1.1 192.167.1.1 223.255.255.254 2a00:1450::5 ::ffff:11.2.3.4".split()
    assert ask(spark, urls.ip_is_private, bad) == [True] * len(bad)
    assert ask(spark, urls.ip_is_private, good) == [False] * len(good)


def test_url_is_safe(spark):
    asked = ["http://garten.test/beete", "gopher://garten.test/", "https://172.20.1.9/x", "http://[fd00:1::2]:8080/", "http://0x7f000001/", "beete", "https://11.22.33.44:8443/x?y"]
    got = ask(spark, lambda c: F.concat_ws(" ", urls.url_is_safe(c)["ok"].cast("string"), urls.url_is_safe(c)["reason"]), asked)
    assert got == ["true", "false scheme", "false private_address", "false private_address", "false private_address", "false invalid_url", "true"]


@pytest.mark.parametrize(("href", "want"), [("rosen", "https://g.test/beete/rosen"), (" /preise\n", "https://g.test/preise"), ("//h.test/rosen", "https://h.test/rosen"), ("?n=2", "https://g.test/beete/tomaten?n=2"), ("../../kasse#unten", "https://g.test/kasse"), ("", "https://g.test/beete/tomaten?z"), ("tel:+49", None), ("data:,x", None)])
def test_resolve(spark, href, want):
    assert spark.range(1).select(urls.resolve_href(F.lit(href), F.lit("https://g.test/beete/tomaten?z#f"))).first()[0] == want


def test_keys_and_sql_functions_agree(spark):
    urls.register_sql(spark)
    r = spark.range(1).select(urls.finding_key(F.lit("https://G.test/rosen/"), F.lit("R"), F.lit(1)), F.expr("finding_key('https://g.test/rosen#x', 'R', 1)"), urls.finding_key(F.lit("https://g.test/rosen"), F.lit("R"), F.lit(2))).first()
    assert r[0] == r[1] != r[2] and len(r[0]) == 16


def test_text(spark):
    assert ask(spark, text.collapse, ["  a\t\nb\u2003c\ufeff ", ""]) == ["a b c", ""]
    assert ask(spark, text.trim_all, ["\u00a0 a  b\u3000", None]) == ["a  b", None]
    assert ask(spark, lambda c: text.slug(c, "x/"), ["--Rosen & T\u00f6pfe 3--"]) == ["x/rosen-t-pfe-3"]
    assert ask(spark, lambda c: text.fixed(c.cast("double"), 2), ["0.125", "-1.005", "3", None]) == ["0.13", "-1.01", "3.00", None]
    assert ask(spark, text.table_cell, ["a|b\nc", None]) == ["a\\|b c", "-"]
    assert ask(spark, lambda c: text.finite(c.cast("double")), ["1.5", "NaN", "Infinity"]) == [1.5, None, None]
