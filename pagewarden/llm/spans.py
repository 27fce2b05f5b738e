"""Where do windows of a fixed length occur more than once? The search that both span operators share.

Every window of `length` symbols (bytes or words) is filed under its anchor: of the `gram`-symbol grams inside it, the
one of the smallest hash, the leftmost of equals. Equal windows hold equal grams, so they have equal anchors at equal
offsets: windows under different anchors need never be compared. Neighbouring windows mostly share an anchor, so a
document is a few rows, one for each run of windows under one anchor; the run's region (all symbols its windows cover)
has a cryptographic digest.

1. Counts by anchor, pre-aggregated before the shuffle, drop all anchors that occur once.
2. Regions of equal digests are one: where all regions of an anchor are, all its windows are repeated.
3. Otherwise one representative of each distinct region is cut out of its text, and those of one anchor meet in one
   task: the operator's own method finds equal windows among them. An anchor of more than `group` distinct regions is
   never gathered: the digests of its regions' windows are counted by a pre-aggregated shuffle and joined back.

So equal strings are told by their symbols (in the method) or by 128-bit BLAKE2 digests, never by a polynomial hash.
The result holds, for each row of the documents, the covered symbols as intervals.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .shared import staged

#: Distinct regions of one anchor that one task compares.
GROUP = 1024
#: Bytes of regions in a batch that goes on, and in a call of a solver (more only if one anchor has more).
SENT, SOLVED = 1 << 22, 1_000_000
#: A row of a group: anchor, the two halves of the region's digest, body, n, at, cnt, mn. A solver gives rows their runs.
BODY, N, AT, CNT, MN = 3, 4, 5, 6, 7
Runs = Iterator[tuple[tuple, list[tuple[int, int, int]]]]
ROWS = "anchor long, region long, region2 long, key long, key2 long, rank long, i0 int, n int, at int"
REGIONS = "anchor long, region long, region2 long, body binary, n int, at int, cnt long, mn long"
FOUND = "anchor long, region long, region2 long, runs array<struct<s:int,e:int,mn:long>>"
REGION = ["anchor", "region", "region2"]
#: What tells the rows of the documents apart.
ROW = ["key", "key2"]


def anchored(symbols: np.ndarray, off: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of documents side by side: for each run of windows its document, first and last start, anchor's place and hash."""
    n, m = len(symbols), length - gram + 1
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none, none.astype(np.uint64)
    p = tv.prefix(symbols, 0)
    grams = tv.mix((p[gram:] - p[:-gram]) * tv.powers(n + 1, 0, True)[: n - gram + 1])
    low = np.uint64((1 << int(n).bit_length()) - 1)
    key = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    at = (tv.sliding_min(key, m) & low).astype(np.int64)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))[: len(at)]
    ok = np.flatnonzero(np.arange(len(at)) + length <= off[doc + 1])
    if not len(ok):
        return none, none, none, none, none.astype(np.uint64)
    a, d = at[ok], doc[ok]
    new = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (d[1:] != d[:-1])))
    return d[new], ok[new], ok[np.append(new[1:] - 1, len(ok) - 1)], a[new], grams[a[new]]


def _symbols(raw: np.ndarray, off: np.ndarray, by_words: bool) -> tuple[np.ndarray, np.ndarray, bytes, np.ndarray, np.ndarray]:
    """Symbols, offsets of documents, and the bytes of symbols with each one's start and end."""
    if by_words:
        h, starts, ends, w = tv.words(raw, off)
        return h, w, *tv.spaced(raw, starts, ends)
    place = np.arange(len(raw) + 1)
    return tv.byte_table(0)[raw], off, raw.tobytes(), place[:-1], place[1:]


def _rows(length: int, gram: int, by_words: bool) -> Callable:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, key2, rank = (b.column(i).to_numpy() for i in (0, 1, 2))
            for row, raw, off in tv.slices(b.column(3)):
                symbols, off, text, starts, ends = _symbols(raw, off, by_words)
                d, first, last, a, anchor = anchored(symbols, off, length, gram)
                region = tv.digests([text[s:e] for s, e in zip(starts[first].tolist(), ends[last + length - 1].tolist(), strict=True)])
                i0 = first - off[d]
                cols = [anchor.view(np.int64), region[:, 0], region[:, 1], key[d + row], key2[d + row], rank[d + row], i0.astype(np.int32), (last - first + 1).astype(np.int32), (a - first).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], [*REGION, *ROW, "rank", "i0", "n", "at"])

    return each


def _cut(length: int, by_words: bool) -> Callable:
    names = [*REGION, "body", "n", "at", "cnt", "mn", "many"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_()]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in names]
            held = 0
            for text, wanted in zip(b.column(0), b.column(1), strict=True):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                parts = raw.split() if by_words else raw
                for w in wanted.as_py():
                    body = parts[w["i0"] : w["i0"] + w["n"] + length - 1]
                    w["body"] = b" ".join(body) if by_words else body
                    held += len(w["body"])
                    for c, name in zip(out, names, strict=True):
                        c.append(w[name])
                    if held > SENT:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names)
                        out, held = [[] for _ in names], 0
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names)

    return each


def _windows(length: int, by_words: bool) -> Callable:
    """Every window of a region as a row with its digest."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, body in enumerate(b.column(BODY)):
                raw = body.as_buffer().to_pybytes()
                size = np.array([len(x) for x in raw.split()]) if by_words else np.zeros(0, np.int64)
                end = np.cumsum(size + 1) - 1 if by_words else np.arange(1, len(raw) + 1)
                start = end - size if by_words else end - 1
                n = b.column(N)[i].as_py()
                w = tv.digests([raw[x:y] for x, y in zip(start[:n].tolist(), end[length - 1 : length - 1 + n].tolist(), strict=True)])
                same = [pa.array(np.full(n, b.column(k)[i].as_py())) for k in (0, 1, 2)]
                yield pa.RecordBatch.from_arrays([*same, pa.array(np.arange(n, dtype=np.int32)), pa.array(w[:, 0]), pa.array(w[:, 1]), *(pa.array(np.full(n, b.column(k)[i].as_py())) for k in (CNT, MN))], [*REGION, "s", "w1", "w2", "cnt", "mn"])

    return each


def _solve(solver: Callable[[list[list[tuple]]], Runs], most: int) -> Callable:
    """Feeds whole anchors, many at a time, to the solver: rows arrive sorted by anchor."""
    runs_type = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32()), ("mn", pa.int64())]))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: list[list[tuple]] = []
        last, held = None, 0

        def done() -> pa.RecordBatch:
            got = list(solver(groups))
            runs = pa.array([[{"s": s, "e": e, "mn": m} for s, e, m in r] for _, r in got], runs_type)
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x, _ in got], pa.int64()) for i in (0, 1, 2)] + [runs], [*REGION, "runs"])

        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if r[0] != last:
                    if held > most:
                        yield done()
                        groups, held = [], 0
                    groups.append([])
                    last = r[0]
                groups[-1].append(r)
                held += len(r[BODY])
        if groups:
            yield done()

    return each


def repeated(docs: DataFrame, length: int, gram: int, by_words: bool, solver: Callable, by_rank: bool, group: int = GROUP) -> DataFrame:
    """docs (key, key2, rank, doc_id, text) with `cover`: intervals (s, e) of the symbols to remove, or null.

    by_rank: a window counts if it also starts in a row of a smaller rank; else if it starts anywhere else.
    solver(groups): of lists of rows of one anchor each, the rows that have runs, with them.
    A run (s, e, mn) says that the windows starting at s..e-1 of the region have mn as the smallest rank anywhere.
    """
    rows = docs.select(*ROW, "rank", "text").mapInArrow(_rows(length, gram, by_words), ROWS)
    rows = staged(rows.withColumn("id", F.monotonically_increasing_id()), "span-rows")
    stats = rows.groupBy("anchor").agg(F.count(F.lit(1)).alias("c"), *(f(c).alias(f"{c}_{x}") for c in REGION[1:] for x, f in (("lo", F.min), ("hi", F.max))), F.min("rank").alias("mn"), F.max("rank").alias("mx"))
    stats = stats.filter((F.col("mn") < F.col("mx")) if by_rank else (F.col("c") > 1)).select("anchor", ((F.col("region_lo") == F.col("region_hi")) & (F.col("region2_lo") == F.col("region2_hi"))).alias("same"), "mn")
    # Staged, both sides of the join are plain shuffles, which Spark splits where an anchor is hot.
    stats = staged(stats, "span-stats")
    kept = staged(rows.join(stats, "anchor"), "span-kept")
    same, mixed = kept.filter("same"), kept.filter("not same").drop("mn")

    reps = mixed.groupBy(*REGION).agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("cnt"), F.min("rank").alias("mn"))
    reps = staged(reps, "span-reps")
    many = staged(reps.groupBy("anchor").agg((F.count(F.lit(1)) > group).alias("many")), "span-many")
    wanted = mixed.join(reps.join(many, "anchor"), [*REGION, "id"])
    by_key = wanted.groupBy(*ROW).agg(F.collect_list(F.struct(*REGION, "i0", "n", "at", "cnt", "mn", "many")).alias("wanted"))
    # A row repeated as a whole cuts its regions twice; such regions occur twice anyway, and covers are sets.
    regions = staged(docs.select(*ROW, "text").join(by_key, ROW).select("text", "wanted").mapInArrow(_cut(length, by_words), f"{REGIONS}, many boolean"), "span-regions")
    few = regions.filter("not many").drop("many").repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_solve(solver, SOLVED), FOUND)
    hot = staged(regions.filter("many").drop("many").mapInArrow(_windows(length, by_words), "anchor long, region long, region2 long, s int, w1 long, w2 long, cnt long, mn long"), "span-windows")
    counts = hot.groupBy("w1", "w2").agg(F.sum("cnt").alias("c"), F.min("mn").alias("m")).filter("c > 1")
    hot = hot.join(counts, ["w1", "w2"]).groupBy(*REGION).agg(F.collect_list(F.struct("s", (F.col("s") + 1).cast("int").alias("e"), F.col("m").alias("mn"))).alias("runs"))
    found = few.unionByName(hot).filter(F.size("runs") > 0)

    whole = same.withColumn("runs", F.array(F.struct(F.lit(0).alias("s"), F.col("n").alias("e"), "mn"))).select(*ROW, "rank", "i0", "runs")
    part = mixed.join(found, REGION).select(*ROW, "rank", "i0", "runs")
    every = whole.unionByName(part)
    runs = F.filter("runs", lambda r: r["mn"] < F.col("rank")) if by_rank else F.col("runs")
    cover = F.transform(runs, lambda r: F.struct((F.col("i0") + r["s"]).alias("s"), (F.col("i0") + r["e"] + (length - 1)).alias("e")))
    covers = every.select(*ROW, cover.alias("cover")).filter(F.size("cover") > 0).groupBy(*ROW).agg(F.flatten(F.collect_set("cover")).alias("cover"))
    return docs.join(covers, ROW, "left")


def merged(cover: list[dict] | None) -> list[tuple[int, int]]:
    """Sorted disjoint intervals; touching ones become one."""
    out: list[tuple[int, int]] = []
    for s, e in sorted((c["s"], c["e"]) for c in cover or ()):
        if out and s <= out[-1][1]:
            if e > out[-1][1]:
                out[-1] = (out[-1][0], e)
        else:
            out.append((s, e))
    return out
