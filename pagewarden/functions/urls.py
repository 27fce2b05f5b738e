"""URL expressions, built-in functions only.

An http(s) URL is taken apart by one anchored expression; Spark's parse_url fails on non-ASCII paths and keeps the case
of hosts and default ports. Paths and queries are percent-encoded and dot segments removed as browsers do. Hosts have one
spelling each (`hosts.py`): Punycode, decimal IPv4 and the shortest IPv6.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .hosts import ascii_host, let, sql_of

PARTS = r"^[\x00-\x20]*([A-Za-z][A-Za-z0-9+.-]*):[/\\]{2}(?:[^/?#\\@]*@)?((?:\[[^\]/?#]*\]|[^/?#\\:\[\]@\s])+)(?::([0-9]*))?(?:([/\\][^?#]*))?(\?[^#]*)?(#.*)?$"
UNSAFE = r'[^\x21-\x7E]|["<>`{}^]'
PLACEHOLDER = "http://pages.invalid"


def _part(c: Column, i: int) -> Column:
    return F.regexp_extract(c, PARTS, i)


def encoded(c: Column, unsafe: str = UNSAFE) -> Column:
    one = lambda x: F.when(x.rlike(unsafe), F.replace(F.url_encode(x), F.lit("+"), F.lit("%20"))).otherwise(x)
    return F.when(c.rlike(unsafe), F.array_join(F.transform(F.regexp_extract_all(c, F.lit("(?s)(.)"), F.lit(1)), one), "")).otherwise(c)


def _no_dots(path: Column) -> Column:
    """Removes . and .. segments of a path that starts with a slash."""
    return F.when(path.rlike(r"(^|/)\.\.?(/|$)"), let(F.split(path, "/"), _kept)).otherwise(path)


def _kept(parts: Column) -> Column:
    segments = F.slice(parts, F.lit(2), F.size(parts))
    last = F.element_at(segments, -1)
    step = lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).when(s == ".", acc).otherwise(F.concat(acc, F.array(s)))
    kept = F.aggregate(segments, F.array().cast("array<string>"), step)
    return let(kept, lambda k: F.concat(F.lit("/"), F.array_join(k, "/"), F.when(last.isin(".", "..") & (F.size(k) > 0), "/").otherwise("")))


def _scheme(c: Column) -> Column:
    return F.lower(_part(c, 1))


def _shaped(c: Column) -> Column:
    """Whether c has the parts of an http(s) URL; its host may still be none."""
    port = _part(c, 3)
    return c.rlike(PARTS) & _scheme(c).isin("http", "https") & ((port == "") | (port.try_cast("int") <= 65535))


def url_host(c: Column) -> Column:
    """The host in its one spelling; null for what is no http(s) URL."""
    return F.when(_shaped(c), ascii_host(_part(c, 2)))


def _is_url(c: Column) -> Column:
    return url_host(c).isNotNull()


def url_origin(c: Column) -> Column:
    """scheme://host[:port] in lower case without a default port; null for what is no http(s) URL."""

    def origin(host: Column) -> Column:
        scheme, port = _scheme(c), F.regexp_replace(_part(c, 3), "^0+(?=[0-9])", "")
        default = ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
        return F.when(host.isNotNull(), F.concat(scheme, F.lit("://"), host, F.when((port == "") | default, "").otherwise(F.concat(F.lit(":"), port))))

    return let(url_host(c), origin)


def _path(c: Column) -> Column:
    return let(F.translate(_part(c, 4), "\\", "/"), lambda raw: F.when(raw == "", "/").otherwise(let(encoded(raw), _no_dots)))


def _query(c: Column) -> Column:
    return let(_part(c, 5), lambda q: F.when(q == "?", "").otherwise(encoded(q, r"[^\x21-\x7E]|[\"<>']")))


def _short(path: Column) -> Column:
    return F.when((F.length(path) > 1) & path.endswith("/"), F.substring(path, F.lit(1), F.length(path) - 1)).otherwise(path)


def normalize_url(c: Column) -> Column:
    """No fragment, no default port, scheme and host in lower case, one trailing slash dropped; the query stays."""
    return let(c, lambda u: F.concat(url_origin(u), let(_path(u), _short), _query(u)))


def url_path(c: Column) -> Column:
    """Normalized path name; null for what is no http(s) URL."""
    return let(c, lambda u: F.when(_is_url(u), let(_path(u), _short)))


def frontier_url(c: Column) -> Column:
    """Normalized, or as it is where it is no URL."""
    return let(c, lambda u: F.coalesce(normalize_url(u), u))


def logical_url(c: Column, placeholder: str = PLACEHOLDER) -> Column:
    """Path and query under a fixed origin, so keys are stable between runs on changing origins."""
    return F.when(_is_url(c), F.concat(F.lit(placeholder), _path(c), _query(c)))


def resolve_href(href: Column, base: Column) -> Column:
    """Absolute http(s) URL of a link without its fragment; null for other schemes and for what cannot be resolved."""
    clean = F.regexp_replace(F.regexp_replace(href, r"^[\x00-\x20]+|[\x00-\x20]+$|[\t\r\n]", ""), "#.*$", "")

    def absolute(h: Column, u: Column, origin: Column) -> Column:
        scheme = F.lower(F.regexp_extract(h, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
        return (
            F.when(scheme.isin("http", "https"), h)
            .when(scheme != "", F.lit(None))
            .when(h.rlike(r"^[/\\]{2}"), F.concat(_scheme(u), F.lit(":"), h))
            .when(h.rlike(r"^[/\\]"), F.concat(origin, h))
            .when(h.startswith("?"), F.concat(origin, _path(u), h))
            .when(h == "", F.concat(origin, _path(u), _query(u)))
            .otherwise(F.concat(origin, F.regexp_replace(_path(u), "[^/]*$", ""), h))
        )

    whole = lambda x: F.concat(url_origin(x), _path(x), _query(x))
    found = lambda u: lambda o: F.when(o.isNotNull(), let(let(clean, lambda h: absolute(h, u, o)), whole))
    return let(base, lambda u: let(url_origin(u), found(u)))


def ip_is_private(c: Column) -> Column:
    """Private, reserved or unrecognized address. Octal, hex and integer spellings are unrecognized, so true.

    `ascii_host` gives addresses the spellings that are recognized here.
    """
    v4 = c.rlike(r"^(0|[1-9][0-9]{0,2})(\.(0|[1-9][0-9]{0,2})){3}$")
    n = F.transform(F.split(c, r"\."), lambda x: x.try_cast("int"))
    a, b = F.get(n, F.lit(0)), F.get(n, F.lit(1))
    bad4 = (
        F.exists(n, lambda x: x > 255) | a.isin(0, 10, 127) | (a >= 224) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168))
        | ((a == 169) & (b == 254)) | ((a == 100) & b.between(64, 127))
    )
    low = F.lower(c)
    v6 = low.rlike(r"^[0-9a-f:]*:[0-9a-f:]*:[0-9a-f:.]*$") & ~low.contains(":::")
    hexed = F.regexp_extract(low, r"^::ffff:([0-9a-f]{1,4}:[0-9a-f]{1,4})$", 1)
    octets = F.flatten(F.transform(F.split(hexed, ":"), lambda x: let(F.conv(x, 16, 10).try_cast("int"), lambda v: F.array(F.shiftright(v, 8), v.bitwiseAND(255)))))
    mapped = F.when(hexed != "", F.array_join(octets, ".")).otherwise(F.regexp_extract(low, r"^::ffff:([0-9]+\.[0-9]+\.[0-9]+\.[0-9]+)$", 1))
    m = F.transform(F.split(mapped, r"\."), lambda x: x.try_cast("int"))
    ma, mb = F.get(m, F.lit(0)), F.get(m, F.lit(1))
    bad_mapped = ma.isin(0, 10, 127) | (ma >= 224) | ((ma == 172) & mb.between(16, 31)) | ((ma == 192) & (mb == 168)) | ((ma == 169) & (mb == 254)) | ((ma == 100) & mb.between(64, 127))
    bad6 = low.isin("::1", "::") | low.rlike("^(fe[89ab]|f[cd])") | F.when(mapped != "", bad_mapped).otherwise(False)
    return F.when(v4, bad4).when(v6, bad6).otherwise(True)


def url_is_safe(c: Column) -> Column:
    """struct<ok, reason>: http(s), and no private address in any spelling."""
    scheme = F.lower(F.regexp_extract(c, r"^[\x00-\x20]*([A-Za-z][A-Za-z0-9+.-]*):", 1))

    def judged(host: Column) -> Column:
        bare = F.regexp_replace(host, r"^\[|\]$", "")
        literal = bare.rlike(r"^[0-9]+(\.[0-9]+){3}$") | bare.contains(":")
        reason = F.when(c.isNull() | (scheme == ""), "invalid_url").when(~scheme.isin("http", "https"), "scheme").when(host.isNull(), "invalid_url").when(literal & ip_is_private(bare), "private_address")
        return F.struct(reason.isNull().alias("ok"), reason.alias("reason"))

    return let(url_host(c), judged)


def finding_key(url: Column, rule_id: Column, version: Column) -> Column:
    """Stable key of a finding: 16 hex digits over the normalized URL, the rule and its version."""
    return _key(normalize_url(url), rule_id, version)


def _key(normalized: Column, rule_id: Column, version: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", normalized, rule_id, version.cast("string")), 256), 1, 16)


def register_sql(spark: SparkSession) -> None:
    """normalize_url, finding_key and url_is_safe as temporary SQL functions, from the columns' own definitions."""
    bodies = {
        "normalize_url(u STRING) RETURNS STRING": normalize_url(F.col("u")),
        "finding_key(u STRING, rule STRING, version INT) RETURNS STRING": _key(F.call_function("normalize_url", F.col("u")), F.col("rule"), F.col("version")),
        "url_is_safe(u STRING) RETURNS BOOLEAN": F.coalesce(url_is_safe(F.col("u"))["ok"], F.lit(False)),
    }
    for head, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {sql_of(body)}")
