"""Hosts of http(s) URLs as columns: one spelling for each name and address.

Names go to lower case, ideographic full stops to dots, and labels with other than ASCII characters to Punycode (RFC 3492).
A host whose last label is a number is an IPv4 address in any of its spellings (one to four parts, each decimal, octal
or hexadecimal) and becomes four decimal parts; in brackets it is an IPv6 address and gets its shortest form. What is
neither has no host. Compatibility forms of characters are not folded beyond lower case, and nothing is composed:
built-in functions have no tables for that.
"""

from __future__ import annotations

import re
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of RFC 3492.
BASE, LOW, HIGH, SKEW, DAMP, BIAS, START = 36, 1, 26, 38, 700, 72, 128
DIGITS = "abcdefghijklmnopqrstuvwxyz0123456789"
#: Digits of one number: enough for any below 2^31.
ROUNDS = 12
PLAIN = r"^(?!(?:.*\.)?0x[0-9a-f]*\.?$)[a-z0-9_.-]*[a-z_-][a-z0-9_-]*\.?$"
NUMERIC = r"^([0-9]+|0x[0-9a-f]*)$"
FORBIDDEN = r"[\x00-\x20#/:<>?@\[\\\]^|%\x7F]"


def let(value: Column, f) -> Column:
    """f(value), with value computed once. Without it an expression that is used twice is computed twice, at every level."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def sql_of(column: Column) -> str:
    """SQL text that parses to the column. Operators print as calls, `and`(a, b), so their names are quoted."""
    token = re.compile(r"'(?:[^'\\]|\\.)*'|\b(and|or|not|in|like|rlike|div|mod)(?=\()|([<>=!%*/+|&^~-]+)(?=\()")
    return token.sub(lambda m: f"`{m[1] or m[2]}`" if m[1] or m[2] else m[0], column._jc.node().sql())


def _long(x) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("long")


def _div(a: Column, b: Column | int) -> Column:
    return F.call_function("div", a, _long(b))


def _number(delta: Column, bias: Column) -> Column:
    """A delta as digits of mixed base."""

    def step(s: Column, i: Column) -> Column:
        t = F.greatest(_long(LOW), F.least(_long(HIGH), i * BASE - bias))
        digit = lambda d: F.substr(F.lit(DIGITS), d.cast("int") + 1, F.lit(1))
        done = F.struct(_long(0).alias("q"), F.concat(s["out"], digit(s["q"])).alias("out"), F.lit(True).alias("done"))
        more = F.struct(_div(s["q"] - t, BASE - t).alias("q"), F.concat(s["out"], digit(t + (s["q"] - t) % (BASE - t))).alias("out"), F.lit(False).alias("done"))
        return F.when(s["done"], s).when(s["q"] < t, done).otherwise(more)

    start = F.struct(delta.alias("q"), F.lit("").alias("out"), F.lit(False).alias("done"))
    return F.aggregate(F.sequence(_long(1), _long(ROUNDS)), start, step, lambda s: s["out"])


def _adapted(delta: Column, count: Column, first: Column) -> Column:
    half = F.when(first, _div(delta, DAMP)).otherwise(_div(delta, 2))
    step = lambda s, _: F.when(s["d"] > (BASE - LOW) * HIGH // 2, F.struct(_div(s["d"], BASE - LOW).alias("d"), (s["k"] + BASE).alias("k"))).otherwise(s)
    start = let(half, lambda d: F.struct((d + _div(d, count)).alias("d"), _long(0).alias("k")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS // 2)), start, step, lambda s: s["k"] + _div(BASE * s["d"], s["d"] + SKEW))


def punycode(label: Column) -> Column:
    """RFC 3492 of a label, without the prefix."""
    points = F.transform(F.regexp_extract_all(label, F.lit("(?s)(.)"), F.lit(1)), lambda c: F.ascii(c).cast("long"))
    basic = F.regexp_replace(label, r"[^\x00-\x7F]", "")

    def encoded(cps: Column) -> Column:
        def each(s: Column, m: Column) -> Column:
            """All places of the code point m, those of smaller ones counted between them."""

            def place(t: Column, c: Column) -> Column:
                out = F.struct(
                    _long(0).alias("delta"), _adapted(t["delta"], t["h"] + 1, t["h"] == _long(F.length(basic))).alias("bias"), (t["h"] + 1).alias("h"), t["n"].alias("n"), F.concat(t["out"], _number(t["delta"], t["bias"])).alias("out"),
                )
                return F.when(c < m, _with(t, t["delta"] + 1, t["n"])).when(c == m, out).otherwise(t)

            begun = _with(s, s["delta"] + (m - s["n"]) * (s["h"] + 1), s["n"])
            return F.aggregate(cps, begun, place, lambda t: _with(t, t["delta"] + 1, m + 1))

        start = F.struct(_long(0).alias("delta"), _long(BIAS).alias("bias"), _long(F.length(basic)).alias("h"), _long(START).alias("n"), F.lit("").alias("out"))
        return F.aggregate(F.array_sort(F.array_distinct(F.filter(cps, lambda c: c >= START))), start, each, lambda s: s["out"])

    return F.concat(basic, F.when(basic == "", "").otherwise("-"), let(points, encoded))


def _with(s: Column, delta: Column, n: Column) -> Column:
    return F.struct(delta.alias("delta"), s["bias"].alias("bias"), s["h"].alias("h"), n.alias("n"), s["out"].alias("out"))


def ipv4(host: Column) -> Column:
    """Four decimal parts of an address in any spelling, in lower case; null for what is none."""
    parts = F.split(F.regexp_replace(host, r"\.$", ""), r"\.")
    value = lambda x: F.when(x.rlike(r"^0x[0-9a-f]*$"), F.coalesce(F.conv(F.nullif(F.substr(x, F.lit(3)), F.lit("")), 16, 10), F.lit("0"))).when(x.rlike("^0[0-7]+$"), F.conv(x, 8, 10)).when(x.rlike("^(0|[1-9][0-9]*)$"), x).try_cast("long")

    def whole(n: Column) -> Column:
        size = F.size(n)
        high = F.slice(n, F.lit(1), size - 1)
        last = F.element_at(n, -1)
        room = F.element_at(F.array(*(_long(256**k) for k in (4, 3, 2, 1))), size)
        # A part that is no number is null, and so is the sum.
        total = F.aggregate(high, F.struct(_long(0).alias("v"), _long(256**3).alias("w")), lambda s, x: F.struct((s["v"] + F.when(x < 256, x) * s["w"]).alias("v"), _div(s["w"], 256).alias("w")), lambda s: s["v"])
        return F.when(size <= 4, total + F.when(last < room, last))

    dotted = lambda v: F.concat_ws(".", *(F.shiftright(v, 8 * k).bitwiseAND(255).cast("string") for k in (3, 2, 1, 0)))
    return let(let(F.transform(parts, value), whole), lambda v: F.when(v.isNotNull(), dotted(v)))


def ipv6(text: Column) -> Column:
    """The shortest form of an address without brackets, in lower case; null for what is none."""
    tail = r"^(.*:)(0|[1-9][0-9]{0,2})\.(0|[1-9][0-9]{0,2})\.(0|[1-9][0-9]{0,2})\.(0|[1-9][0-9]{0,2})$"
    octet = lambda i: F.regexp_extract(text, tail, i).try_cast("int")
    pair = lambda i: F.lower(F.hex(octet(i) * 256 + octet(i + 1)))
    small = octet(2).between(0, 255) & octet(3).between(0, 255) & octet(4).between(0, 255) & octet(5).between(0, 255)
    hexed = F.when(text.contains("."), F.when(text.rlike(tail) & small, F.concat(F.regexp_extract(text, tail, 1), pair(2), F.lit(":"), pair(4)))).otherwise(text)

    def parsed(t: Column) -> Column:
        halves = F.split(t, "::")
        side = lambda i: let(F.coalesce(F.get(halves, F.lit(i)), F.lit("")), lambda h: F.when(h == "", F.array().cast("array<string>")).otherwise(F.split(h, ":")))
        ok = lambda xs: F.forall(xs, lambda x: x.rlike("^[0-9a-f]{1,4}$"))

        def joined(both: Column) -> Column:
            a, b = both["a"], both["b"]
            n = F.size(a) + F.size(b)
            fits = F.when(F.size(halves) == 1, n == 8).otherwise((F.size(halves) == 2) & (n <= 7))
            zeros = F.array_repeat(F.lit("0"), 8 - n)
            pieces = F.transform(F.concat(a, zeros, b), lambda x: F.regexp_replace(x, "^0+(?=.)", ""))
            return F.when(fits & ok(a) & ok(b) & ~t.contains(":::"), F.concat(F.lit(":"), F.array_join(pieces, ":"), F.lit(":")))

        return let(F.struct(side(0).alias("a"), side(1).alias("b")), joined)

    def shortest(j: Column) -> Column:
        """j has a colon before, between and behind its eight pieces; the first of the longest runs of zeros goes."""
        out = F.when(j.isNull(), F.lit(None).cast("string"))
        for k in range(8, 1, -1):
            run = ":0" * k + ":"
            at = F.instr(j, run)
            out = out.when(at > 0, F.concat(F.substr(j, F.lit(2), at - 2), F.lit("::"), F.substr(j, at + len(run), F.greatest(F.length(j) - at - len(run), F.lit(0)))))
        return out.otherwise(F.substr(j, F.lit(2), F.length(j) - 2))

    return let(let(hexed, parsed), shortest)


def ascii_host(host: Column) -> Column:
    """A host as URLs compare it; null for what is none. IPv6 addresses keep their brackets."""
    return F.get(F.call_function("transform", F.array(host), F.expr(_body())), F.lit(0))


@cache
def _body() -> str:
    """The same as the text of a lambda: thousands of calls make the columns once, and one parse each later use."""
    return f"host_ -> {sql_of(_ascii_host(F.col('host_')))}"


def _ascii_host(host: Column) -> Column:

    def name(h: Column) -> Column:
        dots = F.translate(h, "".join(map(chr, (0x3002, 0xFF0E, 0xFF61))), "...")
        labels = lambda d: F.array_join(F.transform(F.split(d, r"\."), lambda x: F.when(x.rlike(r"[^\x00-\x7F]"), F.concat(F.lit("xn--"), punycode(x))).otherwise(x)), ".")
        out = F.when(dots.rlike(r"[^\x00-\x7F]"), let(dots, labels)).otherwise(dots)
        number = lambda d: F.element_at(F.split(F.regexp_replace(d, r"\.$", ""), r"\."), -1).rlike(NUMERIC)
        return let(out, lambda d: F.when((d == "") | d.rlike(FORBIDDEN), F.lit(None)).when(number(d), ipv4(d)).otherwise(d))

    decoded = F.when(host.contains("%"), F.try_url_decode(F.replace(host, F.lit("+"), F.lit("%2B")))).otherwise(host)
    bracket = lambda h: F.when(h.endswith("]"), F.concat(F.lit("["), ipv6(F.substr(h, F.lit(2), F.length(h) - 2)), F.lit("]")))
    return let(F.lower(decoded), lambda h: F.when(h.rlike(PLAIN), h).when(h.startswith("["), bracket(h)).otherwise(name(h)))
