"""Secret scans: Aho-Corasick keyword prefilter, anchored regular expressions near hits only, checksum validation.

One automaton holds every keyword that a secret pattern needs. A text is scanned once; only where a keyword ends is its
anchored expression tried, at that place. Runs of hex digits have no keyword: eight hex digits at every eighth
position of a window of 24 cannot be missed, so a run is looked for with one bounded expression, C-side.

Base kinds: assign, access, hex (n_assign, n_access, n_hex). Added kinds, each with its checksum: `forge` tokens
(ghp_, gho_, ghu_, ghs_, ghr_, npm_: 30 base-62 characters, then 6 that are the CRC-32 of those before) and `key`
(PEM private keys whose body decodes as base64).

Positions are code points, ends exclusive. Defined cases: null and empty texts have no spans; very long texts are
scanned whole, one row at a time; repeated rows repeat their result; null ids stay null.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import docs_of, table

# The patterns of the three base kinds, and the prefixes of checksummed tokens.
ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{24,}")
FORGE = re.compile(rb"(?:gh[pousr]_|npm_)([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
KEY = re.compile(rb"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----\s++([A-Za-z0-9+/=\s]++)-----END (?:[A-Z]+ )?PRIVATE KEY-----")
WORDS = {"assign": ("password", "passwd", "secret", "token", "apikey", "api_key"), "access": ("akia",), "forge": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_"), "key": ("-----begin ",)}
BASE62 = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
KINDS = ("assign", "access", "hex", "forge", "key")
MIN_SECRET, MIN_ACCESS = 6, 20


def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for kind, words in WORDS.items():
        for w in words:
            a.add_word(w, (kind, len(w)))
    a.make_automaton()
    return a


def crc_ok(body: bytes, tail: bytes) -> bool:
    """The last six characters are the CRC-32 of the body in base 62, left-padded."""
    x, out = zlib.crc32(body), b""
    while x:
        x, r = divmod(x, 62)
        out = BASE62[r : r + 1] + out
    return out.rjust(6, b"0") == tail


def pem_ok(body: bytes) -> bool:
    try:
        return len(base64.b64decode(b"".join(body.split()), validate=True)) >= 16
    except binascii.Error:
        return False


def spans_of(text: bytes, lowered: str, found: ahocorasick.Automaton) -> list[tuple[int, str, int]]:
    """Byte spans (start, kind, end). lowered: the text's bytes as Latin-1 characters, A-Z in lower case."""
    out, past = [], dict.fromkeys(WORDS, 0)
    for last, (kind, size) in found.iter(lowered):
        at = last + 1 - size
        if at < past[kind]:
            continue
        if kind == "assign":
            if m := ASSIGN.match(text, at):
                past[kind] = m.end()
                if m.end() - m.start(2) >= MIN_SECRET:
                    out.append((at, kind, m.end()))
        elif kind == "access":
            if m := ACCESS.match(text, at):
                past[kind] = m.end()
                if m.end() - at >= MIN_ACCESS:
                    out.append((at, kind, m.end()))
        elif kind == "forge":
            if (m := FORGE.match(text, at)) and crc_ok(m[1], m[2]):
                past[kind] = m.end()
                out.append((at, kind, m.end()))
        elif (m := KEY.match(text, at)) and pem_ok(m[1]):
            past[kind] = m.end()
            out.append((at, kind, m.end()))
    out += [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[1])))


LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def scan(text: str | None, found: ahocorasick.Automaton) -> list[tuple[int, str, int]]:
    """Spans in code points."""
    if not text:
        return []
    raw = text.encode("utf-8", "surrogatepass")
    spans = spans_of(raw, raw.translate(LOWER).decode("latin-1"), found)
    if len(raw) == len(text) or not spans:
        return spans
    points = lambda i: len(raw[:i].decode("utf-8", "surrogatepass"))
    return [(points(a), k, points(b)) for a, k, b in spans]


def _written(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, k, b in spans)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = automaton()
    for b in batches:
        every = [scan(t.as_py(), found) for t in b.column(1)]
        base = [[s for s in x if s[1] in KINDS[:3]] for x in every]
        counts = [[sum(s[1] == k for s in x) for x in base] for k in KINDS[:3]]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array([hashlib.sha256(_written(x).encode()).hexdigest() for x in base]), pa.array([_written(x) for x in every])],
            ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
        )


def find_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, text) to doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    return docs_of(docs).mapInArrow(_digests, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def masked(text: str | None, found: ahocorasick.Automaton, mask: str = "[SECRET]") -> str | None:
    """Every span, overlapping ones as one, replaced by mask."""
    spans = scan(text, found)
    if not spans:
        return text
    out, at, end = [], 0, -1
    for a, _, b in spans:
        if a >= end:
            out += [text[at:a], mask]
        at = end = max(end, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, column: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """docs with its secrets masked; rows and columns stay."""
    schema = docs.schema

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton()
        for b in batches:
            i = b.schema.names.index(column)
            yield b.set_column(i, b.schema.field(i), pa.array([masked(t.as_py(), found, mask) for t in b.column(i)], b.schema.field(i).type))

    return docs.mapInArrow(each, schema)


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents").select("doc_id", F.col("text")))


# Spans of the base kinds are regular expressions alone; `spans` holds checksummed kinds too, which SQL cannot state.
OP8_SQL = None
