"""Exact top-k inner products by pivot-table elimination.

Vectors are integers (floor(scale * component)). A bounded sample (`sample` rows of the smallest hash of vec_id, of at most
`SAMPLE_WIDTH` components) gives `pivots` pivots, each the row farthest from those before it. The pivot table holds every
row's distances to all pivots, computed once and staged in order of the nearest pivot. By the triangle inequality
d(x, q) >= max over p of |d(x, p) - d(q, p)|, and x.q = (|x|^2 + |q|^2 - d(x, q)^2) / 2, so the table bounds every score
from above. A task evaluates its rows in order of that bound and stops at the first bound below the k-th best score. The
sample's own k-th best score starts every query off; it is a score of real rows, so it cuts nothing that belongs to the
result.

Bounds are doubles with a slack for all that rounding can lose, which follows the norms. Scores are exact: in doubles where
no sum can pass 2^53, in 64-bit integers where none can pass 2^63, and in whole numbers of any size beyond. A score of the
result that no long can hold is an error.

Queries go out in blocks of at most `block` rows (their vectors, pivot distances and starting scores: about 3 MB), one
broadcast after another, against all rows. Partial bests of the tasks are merged by a window over each query.

Defined cases: vectors that are null, or hold nulls, NaN or infinities, take no part, neither do rows without vec_id;
missing components count as zeros, so vectors of any length meet, and a long one widens no other; a query's own rows are
all rows of its vec_id; queries of one vec_id are one query (the smallest vector); repeated rows of other ids are
candidates of their own; ties go to the smaller vec_id.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import shared_dir, staged, table

K = 5
SCALE = 256
EVERY = 50
PIVOTS = 32
SAMPLE = 1024
BLOCK = 4096
CHUNK = 256
#: Longer vectors are in no sample; any vector is a valid pivot.
SAMPLE_WIDTH = 4096
LONG = (1 << 63) - 1
FOUND = "query_id long, vec_id long, score long, over int"


def integers(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, embedding) to (vec_id, v array<double>) of the rows that take part; v holds whole numbers."""
    e = F.col("embedding").cast("array<double>")
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    # Doubles from 2^53 on are whole numbers. A component that leaves the doubles when scaled has no score.
    whole = lambda y: F.when(F.abs(y) < 2.0**53, F.floor(y).cast("double")).when(F.abs(y) == float("inf"), F.raise_error(F.lit("a scaled component is no double")).cast("double")).otherwise(y)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("embedding")).filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.coalesce(bad, F.lit(True))).select(
        "vec_id", F.transform("embedding", lambda x: whole(x * float(scale))).alias("v")
    )


def matrix(rows: list[np.ndarray]) -> np.ndarray:
    out = np.zeros((len(rows), max([1, *map(len, rows)])))
    for o, r in zip(out, rows, strict=True):
        o[: len(r)] = r
    return out


def by_width(rows: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix) of rows of like length: padding at most doubles what rows hold."""
    kind = np.array([len(r).bit_length() for r in rows], np.int64)
    for k in np.unique(kind):
        at = np.flatnonzero(kind == k)
        yield at, matrix([rows[i] for i in at])


def lists(column: pa.Array) -> list[np.ndarray]:
    values, ends = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy() - column.offsets[0].as_py()
    return [values[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def distances(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Columns that one side lacks are zeros. `off` bounds the error."""
    w = min(x.shape[1], p.shape[1])
    with np.errstate(over="ignore", invalid="ignore"):
        return np.nan_to_num(np.sqrt(np.maximum((x**2).sum(1)[:, None] + (p**2).sum(1)[None, :] - 2 * (x[:, :w] @ p[:, :w].T), 0)), nan=np.inf, posinf=np.inf)


def squares(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (x**2).sum(1)


def loss(width: int) -> float:
    """A bound of the relative error of a sum of that many products, generously."""
    return 4 * (width + 8) * np.finfo(float).eps


def products(x: np.ndarray, x_top: np.ndarray, q: np.ndarray, q_top: float) -> np.ndarray:
    """Exact inner products of whole-number rows and q: int64, or Python integers where some do not fit."""
    w = min(x.shape[1], len(q))
    x, q, most = x[:, :w], q[:w], x_top * q_top * w
    if not (most >= 2.0**53).any():
        return (x @ q).astype(np.int64)
    out = np.zeros(len(x), object)
    small, fits = most < 2.0**53, (most >= 2.0**53) & (most < 2.0**62)
    out[small] = (x[small] @ q).astype(np.int64)
    if fits.any():
        out[fits] = x[fits].astype(np.int64) @ q.astype(np.int64)
    used = np.flatnonzero(q)
    whole = [int(v) for v in q[used]]
    for i in np.flatnonzero(~small & ~fits):
        out[i] = sum(int(a) * b for a, b in zip(x[i, used], whole, strict=True))
    return out


def choose_pivots(x: np.ndarray, n: int) -> np.ndarray:
    if not len(x):
        return x
    at, far = [0], distances(x, x[:1])[:, 0]
    while len(at) < min(n, len(x)):
        at.append(int(far.argmax()))
        far = np.minimum(far, distances(x, x[at[-1:]])[:, 0])
    return x[at]


def pivot_table(pivots: np.ndarray) -> Callable:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = lists(b.column(1))
            d = np.zeros((len(rows), len(pivots)))
            for at, x in by_width(rows):
                d[at] = distances(x, pivots)
            near = d.argmin(1)
            pack = lambda a: pa.array([r.tobytes() for r in a], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), pack(rows), pack(d), pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(d)), near])], ["vec_id", "x", "d", "near", "near_d"])

    return each


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    if scores.dtype == object:
        order = sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:k]
    else:
        order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def at_most(score: int) -> float:
    """The score as a double, rounded down."""
    near = float(min(max(score, -(1 << 1000)), 1 << 1000))
    return near if near <= score else float(np.nextafter(near, -np.inf))


@dataclass
class Queries:
    ids: np.ndarray
    rows: list[np.ndarray]
    distances: np.ndarray
    start: np.ndarray  # a score that k rows reach, or -inf
    longest: float  # of the pivots' norms


def search(sent, k: int, n_pivots: int) -> Callable:
    """sent: a broadcast of Queries."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = sent.value
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        top = [none] * len(q.ids)
        level = q.start.copy()
        q_norm = np.array([squares(r[None])[0] for r in q.rows])
        q_top = [float(np.abs(r).max(initial=0)) for r in q.rows]
        for b in batches:
            if not b.num_rows:
                continue
            all_ids = b.column(0).to_numpy()
            all_d = np.frombuffer(b"".join(b.column(2).to_pylist()), np.float64).reshape(-1, n_pivots)
            for at, x in by_width([np.frombuffer(r, np.float64) for r in b.column(1).to_pylist()]):
                ids, d, norm, x_top = all_ids[at], all_d[at], squares(x), np.abs(x).max(1)
                for i in range(len(q.ids)):
                    bound = bounds(norm, q_norm[i], d, q.distances[i], q.longest, max(x.shape[1], len(q.rows[i])))
                    ask = np.flatnonzero((bound >= level[i]) & (ids != q.ids[i]))
                    ask = ask[np.argsort(-bound[ask], kind="stable")]
                    for a in range(0, len(ask), CHUNK):
                        part = ask[a : a + CHUNK]
                        if bound[part[0]] < level[i]:
                            break
                        s = products(x[part], x_top[part], q.rows[i], q_top[i])
                        good = np.asarray(s >= float(level[i]), bool)
                        top[i] = best(np.append(top[i][0], ids[part[good]]), np.append(top[i][1], s[good]), k)
                        if len(top[i][0]) == k:
                            level[i] = max(level[i], at_most(int(top[i][1][-1])))
        n = [len(t[0]) for t in top]
        scores = [int(v) for t in top for v in t[1]]
        over = [(v > LONG) - (v < -LONG - 1) for v in scores]
        kept = [0 if o else v for v, o in zip(scores, over, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q.ids, n)), pa.array(np.concatenate([none[0], *(t[0] for t in top)]).astype(np.int64)), pa.array(kept, pa.int64()), pa.array(over, pa.int32())], ["query_id", "vec_id", "score", "over"])

    return each


def bounds(norm: np.ndarray, q_norm: float, d: np.ndarray, q_d: np.ndarray, longest: float, width: int) -> np.ndarray:
    """An upper bound of each row's score, whatever rounding has lost in norms and distances.

    A squared distance is off by the loss times both norms at most, so a distance by the root of that.
    """
    lost = loss(width)
    with np.errstate(over="ignore", invalid="ignore"):
        off = np.sqrt(lost) * (np.sqrt(norm) + np.sqrt(q_norm) + 2 * longest)
        apart = np.maximum(np.abs(d - q_d).max(1) - off, 0)
        return np.nan_to_num((norm + q_norm - apart**2) / 2 + lost * (norm + q_norm) + 1.0, nan=np.inf, posinf=np.inf, neginf=-np.inf)


def top_k(rows: DataFrame, is_query, k: int = K, scale: int = SCALE, pivots: int = PIVOTS, sample: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """For each row that `is_query` holds for: query_id, rank, vec_id, score of the k highest inner products."""
    spark = rows.sparkSession
    v = integers(rows, scale)
    drawn = v.filter(F.size("v") <= SAMPLE_WIDTH).orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(sample).toArrow()
    s_ids, s = drawn.column("vec_id").to_numpy(), matrix(lists(drawn.column("v").combine_chunks())) if drawn.num_rows else np.zeros((0, 1))
    p = choose_pivots(s, pivots) if len(s) else np.zeros((1, 1))
    made = v.mapInArrow(pivot_table(p), "vec_id long, x binary, d binary, near int, near_d double")
    t = staged(made.repartitionByRange("near", "near_d", "vec_id").sortWithinPartitions("near", "near_d"), "pivot-table")
    q = staged(v.filter(is_query).groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
    count = q.count()
    path = f"{shared_dir(spark).rstrip('/')}/bests-{uuid.uuid4().hex}"
    # Blocks by hash: none is larger than `block` by much, and no count of a block grows with the input.
    blocks = -(-count // block)
    for i in range(blocks):
        got = q.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == i).orderBy("vec_id").toArrow()
        if not got.num_rows:
            continue
        ids, own = got.column("vec_id").to_numpy(), lists(got.column("v").combine_chunks())
        d = np.concatenate([distances(r[None], p) for r in own])
        sent = spark.sparkContext.broadcast(Queries(ids, own, d, starts(ids, own, s_ids, s, k), float(np.sqrt(squares(p).max()))))
        found = t.select("vec_id", "x", "d").mapInArrow(search(sent, k, len(p)), FOUND)
        found.write.mode("append").parquet(path)
    if not blocks:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("over"), F.desc("score"), "vec_id")
    bests = spark.read.schema(FOUND).parquet(path).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    score = F.when(F.col("over") == 0, F.col("score")).otherwise(F.raise_error(F.concat(F.lit("no long holds the score of "), F.col("vec_id").cast("string"))).cast("long"))
    return bests.select("query_id", "rank", "vec_id", score.alias("score"))


def starts(ids: np.ndarray, own: list[np.ndarray], s_ids: np.ndarray, s: np.ndarray, k: int) -> np.ndarray:
    """For each query a score that at least k rows of the sample reach: their k-th best, less what rounding can add."""
    out = np.full(len(ids), -np.inf)
    norms = np.sqrt(squares(s))
    for i, r in enumerate(own):
        w = min(len(r), s.shape[1])
        with np.errstate(over="ignore", invalid="ignore"):
            low = np.ceil(s[:, :w] @ r[:w] - loss(max(len(r), s.shape[1])) * norms * np.sqrt(squares(r[None])[0]))
        low = np.sort(np.nan_to_num(low[s_ids != ids[i]], nan=-np.inf, posinf=-np.inf, neginf=-np.inf))
        if len(low) >= k:
            out[i] = low[-k]
    return out


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)


OP3_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s) WHERE r <= 5
"""
