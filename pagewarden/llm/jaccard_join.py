"""Near duplicates: all pairs of word-shingle sets with Jaccard similarity of 0.75 or more, by enumerated signatures.

The method is PartEnum's: partition the feature domain and enumerate, for every set, parts of which any sufficiently
similar set must share one. Here the partition is the finest, every feature a part of its own. With coarse parts (built
first) a difference on either side spoils a part, so a set must enumerate a third of its parts; a passage that makes up
most of many short documents then puts all of them under common signatures, and nothing tells their pairs apart. With
single features only the set's own differences count: a quarter of them is enumerated, and the place of a shared
signature bounds what two sets can share at all.

All sets enumerate in one global order, rarest first. The order comes from a fixed-size count sketch of all features
(4 MB at any scale); any order gives the same result. Of a set of n features the first n - ceil(0.75 n) + 1 hold a
feature of every partner, and a signature at place i reaches partners of up to (4 n - 7 i) / 3 features, which is the
size band that it is compared in: sets under one signature are compared only where each is within the other's reach.

Identical sets are one node from the start. Signatures travel packed, sorted and without Python objects, by buckets of
the signature. A signature's sets are compared with one of them, the pivot, not with each other; exact set comparison
gives the links, links give components. What then still has two components under one signature is compared across
components, after more rounds of new pivots where that would be many pairs. So the components are those of all links,
and no pair within one component needs to be enumerated.

A signature that the count sketch expects in more than `hot` sets is dealt by a hash of the node too: each part has a
pivot of its own, and the later rounds, which see all parts of a signature as one group, compare across them. So no
task gathers more than a bucket, whatever share of the sets holds one passage.

Defined cases: null and empty texts (no words) have size 0, no links and their own id as component; texts of fewer than
five words are one shingle of their own; repeated rows and equal sets share a component; null ids are never a
component's smallest id unless it has no other; an empty table gives an empty result; very long texts are read whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textvec as tv
from .components import components
from .shared import docs_of, staged, table

SHINGLE = 5
ROWS = 4096  # documents in a slice: 12 bits beside 52 bits of a shingle's hash
BITS, LOW = np.uint64(52), np.uint64((1 << 52) - 1)
SLOTS, BLOCK = 1 << 20, 1 << 14
BUCKET = 150_000  # signatures in a bucket, about
HOT = 50_000  # sets under one signature that meet in one task; what is expected to have more is dealt by node too
HELD = 200_000  # signatures that a task enumerates before it sends them on
SEEN = 50_000  # nodes that an enumerating task remembers
#: Two longs a row and what a hash relation adds: 20 MB at most. Beyond it, texts and representatives are shuffled.
BROADCAST_ROWS = 300_000
CLOSE = 100  # comparisons for each node (50,000 nodes at least) that the last round may have


def sets_of(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct 52-bit shingle hashes, ascending within each document; the document of each; sizes."""
    h, _, _, w = tv.words(raw, off, lower=True)
    docs, n = len(off) - 1, np.diff(w)
    p = tv.prefix(h, 0)
    doc = np.repeat(np.arange(docs), n)
    i = np.flatnonzero(np.arange(len(h)) + SHINGLE <= w[doc + 1]) if len(h) else np.zeros(0, np.int64)
    few = np.flatnonzero((n > 0) & (n < SHINGLE))
    values = np.concatenate([tv.mix(tv.window_hash(p, i, i + SHINGLE, 0)), tv.mix(tv.window_hash(p, w[few], w[few + 1], 0) + n[few].astype(np.uint64))])
    key = (np.concatenate([doc[i], few]).astype(np.uint64) << BITS) | (values >> np.uint64(12))
    key.sort()
    key = key[np.append(True, key[1:] != key[:-1])] if len(key) else key
    doc = (key >> BITS).astype(np.int64)
    return key & LOW, doc, np.bincount(doc, minlength=docs)


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, starts) if len(starts) else np.zeros(0, np.uint64)


def nodes_of(v: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A hash of each non-empty set, 0 for empty ones."""
    out = np.zeros(len(sizes), np.uint64)
    some = np.flatnonzero(sizes)
    out[some] = tv.mix(_sums(tv.mix(v + np.uint64(1)), (np.cumsum(sizes) - sizes)[some]) + sizes[some].astype(np.uint64))
    return out.view(np.int64)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document, and at the end the task's part of the count sketch."""
    counts = np.zeros(SLOTS, np.int64)
    for b in batches:
        n, node = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
        for row, raw, off in tv.slices(b.column(2), rows=ROWS):
            v, doc, sizes = sets_of(raw, off)
            n[row : row + len(sizes)], node[row : row + len(sizes)] = sizes, nodes_of(v, sizes)
            counts += np.bincount((tv.mix(v) >> np.uint64(44)).astype(np.int64), minlength=SLOTS)
        none = pa.nulls(b.num_rows, pa.int32())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n), pa.array(node), none, pa.nulls(b.num_rows, pa.binary())], ["doc_id", "text_key", "n", "node", "block", "counts"])
    blocks = [k for k in range(SLOTS // BLOCK) if counts[k * BLOCK : (k + 1) * BLOCK].any()]
    longs = pa.nulls(len(blocks), pa.int64())
    body = [counts[k * BLOCK : (k + 1) * BLOCK].astype(np.uint32).tobytes() for k in blocks]
    yield pa.RecordBatch.from_arrays([longs, longs, longs, longs, pa.array(blocks, pa.int32()), pa.array(body, pa.binary())], ["doc_id", "text_key", "n", "node", "block", "counts"])


def _sum_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, total = None, np.zeros(BLOCK, np.uint64)
    for b in batches:
        for k, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if k != last and last is not None:
                yield pa.RecordBatch.from_arrays([pa.array([last], pa.int32()), pa.array([np.minimum(total, (1 << 32) - 1).astype(np.uint32).tobytes()], pa.binary())], ["block", "counts"])
                total = np.zeros(BLOCK, np.uint64)
            last = k
            total += np.frombuffer(body, np.uint32)
    if last is not None:
        yield pa.RecordBatch.from_arrays([pa.array([last], pa.int32()), pa.array([np.minimum(total, (1 << 32) - 1).astype(np.uint32).tobytes()], pa.binary())], ["block", "counts"])


def _enumerate(counts, buckets: int, hot: int) -> Callable:
    """Packed (signature, node, size, reach) by bucket and part, 16 bytes each: the signatures that a set must share one of.

    reach of the signature at place i: the size of the largest partner with which it can be the first shared one. What
    the two share is then at most size - i features, and 3/7 of both sizes are needed: (4 * size - 7 * i) // 3.
    part is 0, or from 1 for signatures that are in more than `hot` sets, as the sketch has them above its mean.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freq = np.frombuffer(counts.value, np.uint32)
        shift = np.uint64(max(0, int(freq.max(initial=0)).bit_length() - 20))
        parts = np.maximum(freq.astype(np.int64) - int(freq.mean()) + hot - 1, 0) // hot
        held: list[tuple[np.ndarray, ...]] = []
        seen: set[int] = set()

        def packed() -> pa.RecordBatch:
            sig, node, n, reach = (np.concatenate(c) for c in zip(*held, strict=True))
            most = parts[(sig >> np.uint64(44)).astype(np.int64)]
            part = np.where(most > 1, 1 + (tv.mix(node.view(np.uint64) ^ sig) % np.maximum(most, 1).astype(np.uint64)).astype(np.int64), 0)
            deal = (((sig >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64) << 32) | part
            order = np.argsort(deal, kind="stable")
            sig, node, n, reach, deal = sig[order].astype(np.uint32), node[order], n[order], reach[order], deal[order]
            at = np.flatnonzero(np.append(True, deal[1:] != deal[:-1]))
            end = np.append(at[1:], len(deal))
            # Sizes beyond 65,535 features are rare; where there are any, this lot has four bytes for them.
            wide = int(reach.max()) >= 1 << 16
            n, reach = (x.astype(np.uint32 if wide else np.uint16) for x in (n, reach))
            body = [bytes([wide]) + b"".join(x[i:j].tobytes() for x in (sig, node, n, reach)) for i, j in zip(at.tolist(), end.tolist(), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array((deal[at] >> 32).astype(np.int32)), pa.array(deal[at].astype(np.int32)), pa.array(body, pa.binary())], ["bucket", "part", "body"])

        for b in batches:
            for _, raw, off in tv.slices(b.column(0), rows=ROWS):
                v, d, sizes = sets_of(raw, off)
                node = nodes_of(v, sizes)
                fresh = np.zeros(len(node), bool)
                fresh[np.unique(node, return_index=True)[1]] = True  # copies enumerate once, as far as the task remembers
                ids = node.tolist()
                fresh &= np.array([x not in seen for x in ids], bool)
                if len(seen) > SEEN:
                    seen.clear()
                seen.update(ids)
                sig, d = tv.mix(v[fresh[d]]), d[fresh[d]]
                order = np.argsort((d.astype(np.uint64) << BITS) | (freq[(sig >> np.uint64(44)).astype(np.int64)].astype(np.uint64) >> shift << np.uint64(32)) | (sig & np.uint64(0xFFFFFFFF)))
                d = d[order]
                place, n = np.arange(len(d)) - np.searchsorted(d, d), sizes[d]
                own = place <= n - (3 * n + 3) // 4
                if own.any():
                    held.append((sig[order][own], node[d][own], n[own].astype(np.uint32), ((4 * n - 7 * place) // 3)[own].astype(np.uint32)))
                if sum(len(x[0]) for x in held) > HELD:
                    yield packed()
                    held.clear()
        if held:
            yield packed()

    return each


MET = "grp long, a long, b long, n int, reach int, size int, asked boolean"


def _meet(most: int) -> Callable:
    """Buckets and parts arrive sorted. A row for each node of a signature that can link any: its pivot, and whether to ask for it.

    Two nodes can have this as their first shared signature only if each one's size is within the other's reach. In such
    a pair the smaller node reaches its own size; a signature without such a node links nothing and is dropped. The
    pivot is the node of the largest reach for its size: it has the fewest rarer features of its own.

    Of a part, or of a bucket whose bodies hold more than `most` bytes and so come in several pieces, the rest of a
    signature is out of sight: nothing is dropped, and the later rounds get all its nodes.
    """

    def groups(bucket: int, bodies: list[bytes], whole: bool) -> pa.RecordBatch:
        cols: list[list[np.ndarray]] = [[], [], [], []]
        for x in bodies:
            size = 4 if x[0] else 2
            k, at = len(x) // (12 + 2 * size), 1
            for c, (kind, width) in zip(cols, ((np.uint32, 4), (np.int64, 8), *[(np.uint32 if x[0] else np.uint16, size)] * 2), strict=True):
                c.append(np.frombuffer(x, kind, k, at))
                at += k * width
        sig, node, n, reach = map(np.concatenate, cols)
        order = np.lexsort((node, -(reach / n), sig))
        sig, node, n, reach = sig[order], node[order], n[order].astype(np.int64), reach[order].astype(np.int64)
        keep = np.append(True, (sig[1:] != sig[:-1]) | (node[1:] != node[:-1]))
        sig, node, n, reach = sig[keep], node[keep], n[keep], reach[keep]
        if whole:
            # Who cannot be within reach of any node that reaches its own size has no partner here.
            new = np.append(True, sig[1:] != sig[:-1])
            starts, able = np.flatnonzero(new), reach >= n
            least, largest = np.minimum.reduceat(np.where(able, n, 1 << 40), starts), np.maximum.reduceat(np.where(able, reach, 0), starts)
            at = np.cumsum(new) - 1
            keep = (reach >= least[at]) & (n <= largest[at])
            sig, node, n, reach = sig[keep], node[keep], n[keep], reach[keep]
        first = np.searchsorted(sig, sig)
        size = np.searchsorted(sig, sig, side="right") - first
        use = np.flatnonzero((size > 1) & (reach[first] >= n[first])) if whole else np.arange(len(sig))
        first = first[use]
        asked = (first != use) & (n[use] <= reach[first]) & (n[first] <= reach[use])
        group = (np.int64(bucket) << np.int64(32)) | sig[use].astype(np.int64)
        sizes = size[use] if whole else np.full(len(use), 1 << 30)
        cols = (group, node[first], node[use], n[use].astype(np.int32), reach[use].astype(np.int32), sizes.astype(np.int32), asked)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["grp", "a", "b", "n", "reach", "size", "asked"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, size, cut = (-1, 0), [], 0, False
        for batch in batches:
            for bucket, part, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (bucket, part) != last or size > most:
                    cut = cut or size > most and (bucket, part) == last
                    if held:
                        yield groups(last[0], held, not last[1] and not cut)
                    cut, held, size, last = cut and (bucket, part) == last, [], 0, (bucket, part)
                held.append(body)
                size += len(body)
        if held:
            yield groups(last[0], held, not last[1] and not cut)

    return each


def coarse(v: np.ndarray, n: int) -> np.ndarray:
    """Features of a set by cell of the hash domain, about one a cell; halves of a cell add up to it. A cell counts to 255.

    Counts that differ by d mean sets that differ by d or more, cut off at 255 or not.
    """
    bits = max(5, int(n).bit_length() - 1)
    return np.minimum(np.bincount((v >> np.uint64(52 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8)


def _packed_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for row, raw, off in tv.slices(b.column(1), rows=ROWS):
            v, _, sizes = sets_of(raw, off)
            ends = np.cumsum(sizes)
            sets = [v[e - k : e] for e, k in zip(ends.tolist(), sizes.tolist(), strict=True)]
            bodies = pa.array([x.tobytes() for x in sets], pa.binary())
            cells = pa.array([coarse(x, len(x)).tobytes() for x in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0).slice(row, len(sets)), pa.array(sizes, pa.int64()), cells, bodies], ["node", "n", "cells", "body"])


def _possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose counts by cell leave room for the similarity."""
    for b in batches:
        ok = []
        for na, nb, x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True):
            x, y = np.frombuffer(x, np.uint8).astype(np.int64), np.frombuffer(y, np.uint8).astype(np.int64)
            while len(x) != len(y):
                x, y = (x.reshape(-1, 2).sum(1), y) if len(x) > len(y) else (x, y.reshape(-1, 2).sum(1))
            ok.append(7 * int(np.abs(x - y).sum()) <= na + nb)
        mask = pa.array(ok, pa.bool_())
        yield pa.RecordBatch.from_arrays([b.column(0).filter(mask), b.column(1).filter(mask)], ["a", "b"])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ok = []
        for x, y in zip(b.column(2), b.column(3), strict=True):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            if len(x) > len(y):
                x, y = y, x
            at = np.searchsorted(y, x)
            same = int((y[np.minimum(at, len(y) - 1)] == x).sum())
            ok.append(100 * same >= 75 * (len(x) + len(y) - same))
        mask = pa.array(ok, pa.bool_())
        yield pa.RecordBatch.from_arrays([b.column(0).filter(mask), b.column(1).filter(mask)], ["a", "b"])


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of distinct pairs (a, b), those whose sets have a Jaccard similarity of 0.75 or more.

    Sizes and coarse counts, a few bytes for each pair, rule out nearly all others before whole sets are joined.
    """
    n = sets.select("node", "n", "cells")
    near = pairs.join(n.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("cells").alias("ka")), "a").join(n.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("cells").alias("kb")), "b")
    near = near.filter("100 * least(na, nb) >= 75 * greatest(na, nb)").select("a", "b", "na", "nb", "ka", "kb").mapInArrow(_possible, "a long, b long")
    near = staged(near, "near")
    # Few pairs are left: they go to the sets, so that only sets of such pairs are shuffled.
    sent = F.broadcast if near.count() <= BROADCAST_ROWS else (lambda x: x)
    left = sets.select(F.col("node").alias("a"), F.col("body").alias("x")).join(sent(near), "a")
    right = sets.select(F.col("node").alias("b"), F.col("body").alias("y")).join(sent(near), "b")
    full = left.join(right, ["a", "b"])
    return full.select("a", "b", "x", "y").mapInArrow(_compare, "a long, b long")


def linked_rows(docs: DataFrame, bucket: int = BUCKET, close: int = CLOSE, hot: int = HOT) -> DataFrame:
    """(doc_id, text) to doc_id, text_key, n_shingles, component: one hash for each component, null for empty sets."""
    spark = docs.sparkSession
    d = docs_of(docs).select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"), "text")
    seen = staged(d.mapInArrow(_measure, "doc_id long, text_key long, n long, node long, block int, counts binary"), "sets")
    measured = seen.filter("block is null").select("doc_id", "text_key", "n", "node")
    blocks = seen.filter("block is not null").select("block", "counts").repartition("block").sortWithinPartitions("block").mapInArrow(_sum_blocks, "block int, counts binary")
    counts = np.zeros(SLOTS, np.uint32)
    for r in blocks.collect():  # 64 rows of 64 KB at any scale
        counts[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.frombuffer(r["counts"], np.uint32)
    total = measured.agg(F.sum(F.floor(F.col("n") / 4) + 1)).first()[0] or 0
    buckets = max(64, int(total / bucket))
    order = spark.sparkContext.broadcast(counts.tobytes())
    packed = d.select("text").mapInArrow(_enumerate(order, buckets, hot), "bucket int, part int, body binary")
    met = packed.repartition("bucket", "part").sortWithinPartitions("bucket", "part").mapInArrow(_meet(16 * 4 * bucket), MET)
    met = staged(met, "met")

    pairs = staged(met.filter("asked").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared")), "pairs")
    wanted = met.select(F.col("b").alias("node")).distinct()
    # The row that stands for a node: one that is not repeated, if there is any; only others are made unique by a shuffle.
    row_key = F.xxhash64(F.coalesce("doc_id", F.lit(-1)), F.col("doc_id").isNull(), "text_key")
    rep = measured.filter("n > 0").groupBy("node", row_key.alias("row")).agg(F.count(F.lit(1)).alias("c")).groupBy("node").agg(F.min(F.struct("c", "row")).alias("m"))
    rep = staged(rep.join(wanted, "node").select("node", "m.*"), "representatives")
    known = rep.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("c") > 1).alias("repeated")).first()
    rep = F.broadcast(rep) if known["rows"] <= BROADCAST_ROWS else rep
    texts = d.select(row_key.alias("row"), "text").join(rep, "row").select("node", "text", "c")
    made = lambda df: df.select("node", "text").mapInArrow(_packed_sets, "node long, n long, cells binary, body binary")
    sets = made(texts.filter("c = 1"))
    sets = staged(sets.unionByName(made(texts.filter("c > 1")).dropDuplicates(["node"])) if known["repeated"] else sets, "packed-sets")

    # First each node with the pivot it shares most with, then what is left between components, then other pivots.
    best = pairs.groupBy("b").agg(F.max_by("a", F.struct("shared", "a")).alias("a"))
    links = staged(_linked(best, sets), "links")
    comps = components(links)

    def comp(df: DataFrame, node: str, out: str) -> DataFrame:
        c = comps.select(F.col("node").alias(node), F.col("comp").alias(out))
        return df.join(c, node, "left").withColumn(out, F.coalesce(out, node))

    def apart(df: DataFrame) -> DataFrame:
        return comp(comp(df, "a", "ca"), "b", "cb").filter("ca <> cb").select("a", "b")

    def join_up(tested: DataFrame) -> None:
        nonlocal links, comps
        new = staged(_linked(tested, sets), "links")
        if new.limit(1).count():
            links = links.unionByName(new)
            comps = components(links)

    join_up(apart(pairs.join(best, ["a", "b"], "left_anti")))
    members = met.filter("size > 2").select("grp", F.col("b").alias("node"), "n", "reach")
    fits = (F.col("n") <= F.col("rb")) & (F.col("nb") <= F.col("reach"))
    nodes, turn = wanted.count(), 0
    while True:
        m = comp(members, "node", "c").withColumn("able", F.col("reach") >= F.col("n"))
        # Groups of equal members (several signatures of one passage, say) are one group. A pair across components has
        # a node outside the group's largest component, and one that reaches its own size.
        by_comp = m.groupBy("grp", "c").agg(F.count(F.lit(1)).alias("k"), F.count_if("able").alias("able"), F.sum(F.shiftright(F.xxhash64("node", "reach"), 16)).alias("h"))
        state = by_comp.groupBy("grp").agg(F.max_by("c", F.struct("k", "c")).alias("major"), F.max("k").alias("big"), F.sum("k").alias("k"), F.sum("able").alias("able"), F.max_by("able", F.struct("k", "c")).alias("major_able"), F.sum("h").alias("h"))
        state = state.filter("k > big and able > 0").groupBy("k", "h", "able").agg(F.min(F.struct("grp", "major", ((F.col("able") - F.col("major_able")) * F.col("k") + (F.col("k") - F.col("big")) * F.col("able")).alias("load"))).alias("g"))
        members = staged(m.join(state.select("g.*"), "grp").select("grp", "node", "n", "reach", "c", "able", (F.col("c") != F.col("major")).alias("minor"), "load"), "members")
        load = members.groupBy("grp").agg(F.first("load").alias("load")).agg(F.sum("load").alias("pairs"), F.count(F.lit(1)).alias("groups")).first()
        if not load["groups"]:
            break
        other = members.select("grp", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("reach").alias("rb"), F.col("c").alias("cb"), F.col("able").alias("able_b"))
        if load["pairs"] <= close * max(50_000, nodes):
            both = members.filter("minor and able").join(other, "grp").unionByName(members.filter("minor and not able").join(other.filter("able_b"), "grp"))
            asked = both.filter((F.col("c") != F.col("cb")) & fits).select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b")).distinct()
            join_up(asked)
            break
        # A pivot has been asked for all of its group once this round is over, so it leaves the group.
        pivot = other.filter("able_b").groupBy("grp").agg(F.max_by(F.struct("b", "nb", "rb", "cb"), F.struct(F.col("rb") / F.col("nb"), F.xxhash64("b", F.lit(turn)))).alias("p")).select("grp", "p.*")
        both = members.join(pivot, "grp")
        asked = both.filter((F.col("c") != F.col("cb")) & fits).select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b")).distinct()
        members = both.filter("node <> b").select("grp", "node", "n", "reach")
        join_up(asked)
        turn += 1

    out = measured.withColumn("node", F.when(F.col("n") > 0, F.col("node")))
    return comp(out, "node", "component").select("doc_id", "text_key", F.col("n").alias("n_shingles"), "component")


def near_duplicates(docs: DataFrame, bucket: int = BUCKET, close: int = CLOSE, hot: int = HOT) -> DataFrame:
    """(doc_id, text) to doc_id, n_shingles, component_id (the component's smallest doc_id; an empty set's own)."""
    rows = staged(linked_rows(docs, bucket, close, hot), "linked-rows")
    ids = rows.filter("component is not null").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    out = rows.join(ids, "component", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """Rows of docs: of every component the one of the smallest doc_id, nulls last; rows without words all stay.

    Rows repeated as a whole are one row; of rows that differ in other columns alone, the one whose columns come first as
    JSON stays. Columns stay as they are.
    """
    rows = linked_rows(docs)
    least = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("text_key").alias("key"))
    grouped = F.coalesce(F.col("component").cast("string"), F.concat_ws("|", F.lit("empty"), "doc_id", "text_key"))
    stay = rows.groupBy(grouped.alias("c")).agg(F.min(least).alias("m")).select(F.col("m.id").alias("__id"), F.col("m.key").alias("__key"))
    rest = [F.col(c) for c in docs.columns if c not in ("doc_id", "text")]
    order = F.to_json(F.struct(*rest)) if rest else F.lit("")
    d = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), order.alias("__order"), F.col("doc_id").cast("long").alias("__doc"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("__text"))
    j = d.join(stay, d["__doc"].eqNullSafe(stay["__id"]) & (d["__text"] == stay["__key"]))
    once = Window.partitionBy("__doc", "__text").orderBy("__order")
    return j.withColumn("__n", F.row_number().over(once)).filter("__n = 1").select("row.*")


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS k, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sh AS (SELECT DISTINCT k, array_to_string(w[i:i+4], ' ') AS s FROM (SELECT k, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT k, count(*) AS n FROM sh GROUP BY k),
p AS (SELECT a.k AS a, b.k AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.k < b.k GROUP BY a.k, b.k),
e AS (SELECT a, b FROM p JOIN n x ON x.k = a JOIN n y ON y.k = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
g AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT a, b FROM g UNION SELECT r.a, g.b FROM r JOIN g ON r.b = g.a),
m AS (SELECT a AS k, min(doc_id) AS least_id FROM r JOIN d ON d.k = r.b GROUP BY a)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(least(doc_id, least_id), doc_id) AS component_id FROM d LEFT JOIN n USING (k) LEFT JOIN m USING (k)
"""
