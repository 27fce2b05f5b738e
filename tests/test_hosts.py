"""Hosts: Punycode, addresses in every spelling, and SQL functions that are the columns."""

import ipaddress
import random

from pyspark.sql import functions as F
from test_urls import ask

from pagewarden.functions import hosts, urls


def test_punycode(spark):
    r = random.Random(1)
    letters = "abc-09" + "".join(map(chr, (0xE4, 0xF6, 0xFC, 0xDF, 0xE7, 0xF1, 0x4E2D, 0x6587, 0x5B57, 0x44F, 0x1F600, 0x10FFFF)))
    labels = ["bücher", "中文", "ü", "a" * 55 + "ü", "ü" * 59] + ["".join(r.choices(letters, k=r.randint(1, 25))) for _ in range(150)]
    labels = [x for x in labels if not x.isascii()]
    assert ask(spark, hosts.punycode, labels) == [x.encode("punycode").decode() for x in labels]


def short(text):
    """The first longest run of zeros as ::, by plain Python."""
    try:
        raw = ipaddress.IPv6Address(text).packed
    except ValueError:
        return None
    p = [f"{int.from_bytes(raw[k : k + 2]):x}" for k in range(0, 16, 2)]
    n, at = max(((n, -i) for i in range(8) for n in range(2, 9 - i) if p[i : i + n] == ["0"] * n), default=(0, 0))
    return ":".join(p[:-at]) + "::" + ":".join(p[n - at :]) if n else ":".join(p)


def test_ipv6(spark):
    r = random.Random(2)
    texts = [":".join(r.choice(["0", "0", "00", "1", "0ab", "ffff"]) for _ in range(8)) for _ in range(150)]
    texts += ["::", "::1", "1::", "fe80::1", "2001:db8::1:0:0:1", "::ffff:1.2.3.4", "64:ff9b::192.0.2.33", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1:2:3:4:5:6:1.2.3.4"]
    texts += ["1::2::3", ":::", "1:2:3", "12345::", "1:2:3:4:5:6:7:8:9", "::1.2.3", "::1.2.3.256", "::01.2.3.4", "g::", ":1", "1:", "", "1.2.3.4", "1:2:3:4:5:6:7:8::"]
    assert ask(spark, hosts.ipv6, texts) == [short(x) for x in texts]


def test_hosts(spark):
    cases = {
        "0177.0.0.1": "127.0.0.1", "2130706433": "127.0.0.1", "0x7F000001": "127.0.0.1", "127.1": "127.0.0.1", "0x7f.0.0x1": "127.0.0.1", "1.2.3.4.": "1.2.3.4", "4294967295": "255.255.255.255", "0x": "0.0.0.0", "1.65536": "1.1.0.0",
        "256.1.1.1": None, "1.2.3.4.5": None, "08.1.1.1": None, "4294967296": None, "1.0x1000000": None, "a.1": None, "a.0x1": None, "99999999999999999999": None, "1..2": None, "1.2.3.4..": "1.2.3.4..",
        "1.a": "1.a", "0xg": "0xg", "Shop.Test.": "shop.test.", "a_b.c-d": "a_b.c-d", "Bücher.DE": "xn--bcher-kva.de", "b%C3%BCcher.de": "xn--bcher-kva.de", "%41.de": "a.de", "a。de": "a.de", "faß.de": "xn--fa-hia.de",
        "a b": None, "a%2fb": None, "%": None, "": None, "[::1]": "[::1]", "[0:0:0:0:0:0:0:1]": "[::1]", "[::FFFF:127.0.0.1]": "[::ffff:7f00:1]", "[1": None, "[::g]": None,
    }
    assert dict(zip(cases, ask(spark, hosts.ascii_host, list(cases)), strict=True)) == cases


def test_one_key_for_every_spelling(spark):
    same = ["http://127.0.0.1/", "http://0177.0.0.1", "http://2130706433#x", "http://0x7f.1:80/", "HTTP://u:p@127.0.0.1."]
    names = ["https://bücher.test/x", "https://BÜCHER.test:443/x/", "https://xn--bcher-kva.test/x"]
    for urls_ in (same, names, ["http://[::1]/", "http://[0:0::0:1]/", "http://[0000:0:0:0:0:0:0:0001]"]):
        assert len(set(ask(spark, lambda c: urls.finding_key(c, F.lit("R"), F.lit(1)), urls_))) == 1


def test_sql_functions_are_the_columns(spark):
    urls.register_sql(spark)
    asked = ["http://[::ffff:10.0.0.1]/", "http://[::ffff:a00:1]/", "http://0177.0.0.1/", "http://134744072/", "http://a.test:99999/", "http://221.1.1.1", "http://fd-shop.test/", "http://fe80.test", "http://BÜCHER.test/a/../b", "http://a.test:080/ü\\x"]
    asked += ["https://x.test:443/q?#f", None, "nope", "http://1.2.3.4.5/", "HTTP://u:p@EX.test/%7e/./", "ftp://a.test/", "http://192.168.1.1", "http:///", "http://a.test/?'\"\\", "http://100.64.0.1/", "http://[fe80::1]/"]
    df = spark.createDataFrame([(x,) for x in asked], "u string")
    both = df.select(urls.normalize_url(F.col("u")), F.expr("normalize_url(u)"), F.coalesce(urls.url_is_safe(F.col("u"))["ok"], F.lit(False)), F.expr("url_is_safe(u)"), urls.finding_key(F.col("u"), F.lit("R"), F.lit(2)), F.expr("finding_key(u, 'R', 2)")).collect()
    assert all(r[0] == r[1] and r[2] == r[3] and r[4] == r[5] for r in both)
    assert [u for u, r in zip(asked, both, strict=True) if r[3]] == ["http://134744072/", "http://221.1.1.1", "http://fd-shop.test/", "http://fe80.test", "http://BÜCHER.test/a/../b", "http://a.test:080/ü\\x", "https://x.test:443/q?#f", "HTTP://u:p@EX.test/%7e/./", "http://a.test/?'\"\\"]
