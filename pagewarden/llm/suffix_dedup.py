"""Suffix-array dedup over bytes, by a hash-compared suffix sort.

`spans.repeated` brings the distinct regions under one anchor together. Their suffixes that start at the anchor are
mergesorted; two suffixes are compared by the length of their common extension, found by binary search over prefix
polynomial hashes, so a comparison takes a logarithmic number of hash comparisons. Neighbours in sorted order whose
common extension is k or more share the k bytes from the anchor on, so runs of them are the regions that do. A window of
`length` bytes with x bytes left of the anchor occurs again where two regions of such a run (k = length - x) have equal
prefix hashes of the x bytes left of the anchor, too. A region is then compared byte by byte with the first that it
shares windows with, once for all neighbouring windows; should equal hashes of different bytes turn up, the windows of
that anchor are compared as bytes instead. The work is the same for an anchor of two regions and of GROUP regions: it
grows with their bytes, not with their pairs. An anchor of more than GROUP distinct regions takes the counted-windows
way of `spans.repeated`, which is exact too and gathers nothing.

Defined cases: null and empty texts have no bytes; repeated rows are rows of their own, so they remove each other's
repeated bytes; a string that occurs twice in one document is removed in both places, overlaps included; texts of
fewer than `length` bytes lose none; very long texts are handled whole; null ids stay null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textvec as tv
from .shared import docs_of, row_keys, table
from .spans import AT, BODY, CNT, N, Runs, merged, repeated

LENGTH = 400
GRAM = 128
#: Distinct regions of one anchor that a task may gather: at most 2.7 MB of text.
GROUP = 4096


class Suffixes:
    """Regions side by side in one buffer, each with an anchor; compares what lies right and left of two anchors."""

    def __init__(self, bodies: list[bytes], at: np.ndarray):
        self.raw = b"".join(bodies)
        ends = np.cumsum([len(b) for b in bodies])
        self.start, self.end = ends - [len(b) for b in bodies], ends
        self.anchor = self.start + at
        self.bytes = np.frombuffer(self.raw, np.uint8)
        self.p = tv.prefix(tv.byte_table(0)[self.bytes], 0)
        self.inverse = tv.powers(len(self.p), 0, True)

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.p[end] - self.p[start]) * self.inverse[start]

    def right(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common extension from the anchors to the right."""
        pa_, pb = self.anchor[a], self.anchor[b]
        lo, hi = np.zeros(len(a), np.int64), np.minimum(self.end[a] - pa_, self.end[b] - pb)
        while (lo < hi).any():
            mid = (lo + hi + 1) // 2
            same = self.hash(pa_, pa_ + mid) == self.hash(pb, pb + mid)
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
        return lo

    def before_anchor(self, a: np.ndarray, x: int) -> np.ndarray:
        """Hashes of the x bytes left of the anchors."""
        at = self.anchor[a]
        return self.hash(at - x, at)

    def before(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Is suffix a smaller than suffix b? A suffix that ends first is."""
        k = self.right(a, b)
        pa_, pb = self.anchor[a] + k, self.anchor[b] + k
        over_a, over_b = pa_ >= self.end[a], pb >= self.end[b]
        last = max(len(self.bytes) - 1, 0)
        return np.where(over_a | over_b, over_a & ~over_b, self.bytes[np.minimum(pa_, last)] < self.bytes[np.minimum(pb, last)])

    def sort(self, group: np.ndarray) -> np.ndarray:
        """Mergesort within every group at once, bottom up. group: ascending group number of each region."""
        n = len(group)
        order, first = np.arange(n), np.searchsorted(group, group)
        place = np.arange(n) - first
        last = np.searchsorted(group, group, side="right")
        width, most = 1, int((last - first).max(initial=0))
        while width < most:
            run = first + place // width * width  # start of the sorted run at every place
            odd = place // width % 2 == 1
            mate = np.where(odd, run - width, np.minimum(run + width, last))
            mate_end = np.where(odd, run, np.minimum(run + 2 * width, last))
            lo, hi = mate.copy(), mate_end.copy()
            while True:  # how many of the other run come first
                open_ = np.flatnonzero(lo < hi)
                if not len(open_):
                    break
                mid = (lo[open_] + hi[open_]) // 2
                mine, other = order[open_], order[mid]
                less = self.before(other, mine) | (odd[open_] & ~self.before(mine, other))
                lo[open_] = np.where(less, mid + 1, lo[open_])
                hi[open_] = np.where(less, hi[open_], mid)
            at = np.where(odd, run - width, run) + (np.arange(n) - run) + (lo - mate)
            out = np.empty(n, np.int64)
            out[at] = order
            order, width = out, width * 2
        return order


def by_bytes(regions: list[tuple]) -> list[list[tuple[int, int]]]:
    """Repeated starts of each region, by its windows' bytes."""
    seen: dict[bytes, int] = {}
    for r in regions:
        for i in range(r[N]):
            w = r[BODY][i : i + LENGTH]
            seen[w] = seen.get(w, 0) + r[CNT]
    return [[(i, i + 1) for i in range(r[N]) if seen[r[BODY][i : i + LENGTH]] > 1] for r in regions]


def shared(s: Suffixes, group: np.ndarray, n: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """(region, other region, from, to): windows with from..to bytes left of the anchor are in both, by their hashes."""
    order = s.sort(group)
    near = np.full(len(order), -1)
    i = np.flatnonzero(group[order[:-1]] == group[order[1:]])
    near[i] = s.right(order[i], order[i + 1])
    least, most = (at - n + 1)[order], at[order]
    mine, mate, left = [], [], []
    for x in range(int(least.min()), int(most.max()) + 1):
        run = np.cumsum(np.append(0, near[:-1] < LENGTH - x))
        p = np.flatnonzero((least <= x) & (x <= most))
        h = s.before_anchor(order[p], x)
        by = np.lexsort((h, run[p]))
        p, h = p[by], h[by]
        new = np.append(True, (h[1:] != h[:-1]) | (run[p[1:]] != run[p[:-1]]))
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(p)))
        first = np.repeat(start, size)
        other = np.where(new, np.minimum(first + 1, len(p) - 1), first)
        hit = np.repeat(size > 1, size)
        mine.append(order[p[hit]])
        mate.append(order[p[other[hit]]])
        left.append(np.full(int(hit.sum()), x))
    mine, mate, left = (np.concatenate(c) for c in (mine, mate, left))
    by = np.lexsort((left, mate, mine))
    mine, mate, left = mine[by], mate[by], left[by]
    new = np.append(True, (mine[1:] != mine[:-1]) | (mate[1:] != mate[:-1]) | (left[1:] != left[:-1] + 1)) if len(mine) else np.zeros(0, bool)
    start = np.flatnonzero(new)
    return mine[start], mate[start], left[start], left[np.append(start[1:], len(left)) - 1] if len(start) else left[start]


def solve(groups: list[list[tuple]]) -> Runs:
    rows = [r for g in groups for r in g]
    group = np.repeat(np.arange(len(groups)), [len(g) for g in groups])
    n, at = np.array([r[N] for r in rows], np.int64), np.array([r[AT] for r in rows], np.int64)
    s = Suffixes([r[BODY] for r in rows], at)
    runs: list[list[tuple[int, int]]] = [[(0, r[N])] if r[CNT] > 1 else [] for r in rows]
    doubted = set()
    for x, y, lo, hi in zip(*(c.tolist() for c in shared(s, group, n, at)), strict=True):
        px, py = int(s.anchor[x]), int(s.anchor[y])
        if s.raw[px - hi : px + LENGTH - lo] == s.raw[py - hi : py + LENGTH - lo]:
            runs[x].append((int(at[x]) - hi, int(at[x]) - lo + 1))
        else:
            doubted.add(int(group[x]))  # equal hashes of different bytes
    for g in doubted:
        of = np.flatnonzero(group == g)
        for x, own in zip(of.tolist(), by_bytes(groups[g]), strict=True):
            runs[x] = own
    for r, x in zip(rows, runs, strict=True):
        if x:
            yield r, [(a, b, 0) for a, b in merged([{"s": a, "e": b} for a, b in x])]


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out: list[list] = [[], [], [], [], []]
        for doc_id, text, cover in zip(*b.columns, strict=True):
            raw = text.as_buffer().to_pybytes() if text.is_valid else b""
            spans, kept, at = merged(cover.as_py()), [], 0
            for s, e in spans:
                kept.append(raw[at:s])
                at = e
            kept.append(raw[at:])
            rest = b"".join(kept)
            for c, v in zip(out, (doc_id.as_py(), len(raw), len(raw) - len(rest), len(spans), rest), strict=True):
                c.append(v)
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out[:4]), pa.array(out[4], pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def dedup_bytes(docs: DataFrame, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """(doc_id, text) to doc_id, n_bytes, n_removed, n_spans, kept (remaining bytes; they need not be UTF-8)."""
    d = docs_of(docs)
    d = d.select(*row_keys(F.col("doc_id"), F.col("text")), F.lit(0).cast("long").alias("rank"), "doc_id", "text")
    covered = repeated(d, LENGTH, gram, False, solve, by_rank=False, group=group)
    return covered.select("doc_id", "text", "cover").mapInArrow(_keep, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_bytes(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS k, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT doc_id, k, h, CAST(length(h) // 2 AS BIGINT) AS n FROM d),
pc AS (SELECT k, p, h[2*p+1:2*p+1598] AS hp, least(400, n - 399 - p) AS m FROM (SELECT k, h, n, unnest(range(0, n - 399, 400)) AS p FROM b WHERE n >= 400)),
win AS (SELECT k, p + j AS i, md5(hp[2*j+1:2*j+800]) AS m FROM (SELECT k, p, hp, unnest(range(0, m)) AS j FROM pc)),
hit AS (SELECT k, i FROM win JOIN (SELECT m FROM win GROUP BY m HAVING count(*) > 1) USING (m)),
isl AS (SELECT k, i, sum(CASE WHEN i > prev + 400 THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY i ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT k, i, lag(i) OVER (PARTITION BY k ORDER BY i) AS prev FROM hit)),
sp AS (SELECT k, min(i) AS s, max(i) + 400 AS e FROM isl GROUP BY k, g),
gap AS (SELECT k, coalesce(lag(e) OVER (PARTITION BY k ORDER BY s), 0) AS s, s AS e FROM sp UNION ALL SELECT b.k, coalesce(max(e), 0), any_value(n) FROM b LEFT JOIN sp USING (k) GROUP BY b.k),
kept AS (SELECT k, string_agg(h[2*s+1:2*e], '' ORDER BY s) AS x FROM gap JOIN b USING (k) GROUP BY k)
SELECT doc_id, n AS n_bytes, CAST(n - length(x) // 2 AS BIGINT) AS n_removed, CAST(coalesce(c, 0) AS BIGINT) AS n_spans, sha256(unhex(x)) AS kept_sha256
FROM b JOIN kept USING (k) LEFT JOIN (SELECT k, count(*) AS c FROM sp GROUP BY k) USING (k)
"""
