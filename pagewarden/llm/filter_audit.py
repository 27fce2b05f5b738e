"""How five filters act together: what each removes, alone and behind the others, in every order.

A document fails a subset of the filters, one of 32 cells. Counts by part and cell (of all documents, of good ones, of
toxic ones) are all that the audit needs; they are a tensor of shape 2x2x2x2x2 for each part and measure. Every number
asked for is a contraction of it: along each axis a filter is passed, failed, or not looked at (summed). For a step of an
order, the filters before it are passed and its own is failed for what it removes; the ones after it are not looked at.
One einsum answers all steps of all orders for a batch of parts.

Texts are read once and leave their scan as five bits and a digest; texts of one digest meet in pre-aggregated counts, so
a third of all rows with one text is a few rows behind the scan.

Defined cases: a null text is empty and equal to empty texts; a null source is the part of the empty name; a null doc_id
has no label, is no smaller than any other and never fails E; repeated rows have equal ids and so do not fail E for each
other; of an id's labels any 1 counts; an empty table has no parts and no rows; other columns are not read. Equal texts
means equal SHA-256.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import docs_of, staged, table

FILTERS = "ABCDE"
MEASURES = ("all", "good", "toxic")
NOT_CAPITALS = bytes(b for b in range(256) if not 65 <= b <= 90)
CONTINUES = bytes(range(0x80, 0xC0))
SPECIAL = re.compile(rb"[#$%&*|]")
#: Parts of a batch: the result has 600 rows for each.
PARTS = 50


def failures(text: bytes) -> int:
    """Bits 0 to 3: the text fails A (few words), B (repeats words), C (capitals), D (special characters)."""
    words = text.split()  # by the six ASCII white spaces, as bytes are
    capitals, points = len(text.translate(None, NOT_CAPITALS)), len(text.translate(None, CONTINUES))
    return (len(words) < 50) | (100 * len(set(words)) < 65 * len(words)) << 1 | (100 * capitals > 5 * points) << 2 | bool(SPECIAL.search(text)) << 3


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, part, bits, digest, good, toxic) of every row; bits as of `failures`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits = pa.array([failures(t.as_buffer().to_pybytes()) for t in b.column("text")], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("part"), b.column("digest"), bits], ["doc_id", "part", "digest", "bits"])

    text = F.coalesce("text", F.lit(""))
    d = docs_of(docs, F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"))
    d = d.select("doc_id", "part", F.unhex(F.sha2(text, 256)).alias("digest"), F.encode(text, "UTF-8").alias("text"))
    d = d.mapInArrow(run, "doc_id long, part string, digest binary, bits int")
    known = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("__id"))
    known = known.agg(*(F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias(n) for c, n in (("quality", "good"), ("toxic", "toxic"))))
    one = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return d.join(known, d["doc_id"] == known["__id"], "left").select("doc_id", "part", "bits", "digest", one("good"), one("toxic"))


def cells(rows: DataFrame) -> DataFrame:
    """(part, cell, all, good, toxic): documents by the filters they fail; bit k of cell is filter k.

    E by counts alone: of all rows of a text, those with its smallest doc_id pass, the others fail.
    """
    text, kind = ["digest", "bits"], ["part", "good", "toxic"]
    by_id = rows.groupBy(*text, *kind, "doc_id").agg(F.count("*").alias("n"))
    least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n")))
    groups = by_id.groupBy(*text, *kind).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("unnamed"), least.alias("least"))
    # A text's row count is now that of its parts and labels; its smallest id decides among them.
    each = groups.withColumn("first", F.min("least.doc_id").over(Window.partitionBy(*text)))
    passing = F.col("unnamed") + F.when(F.col("least.doc_id") == F.col("first"), F.col("least.n")).otherwise(0)
    split = F.explode(F.array(F.struct(F.col("bits").alias("cell"), passing.alias("n")), F.struct((F.col("bits") + 16).alias("cell"), (F.col("n") - passing).alias("n"))))
    each = each.select(*kind, split.alias("c")).select(*kind, "c.*").filter("n > 0")
    return each.groupBy("part", "cell").agg(F.sum("n").alias("all"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def audit(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of what `cells` gave."""
    k, size = len(filters), 1 << len(filters)
    orders = list(permutations(range(k)))
    names = ["".join(filters[f] for f in o) for o in orders]
    passed, failed, either = np.array([1, 0]), np.array([0, 1]), np.array([1, 1])
    steps = [(o, i) for o in orders for i in range(k)]
    at = np.array([o[i] for o, i in steps])

    def selectors(own: np.ndarray) -> list[np.ndarray]:
        """For each axis, what every step selects along it: passed before the step, `own` at it, all after it."""
        out = np.empty((k, len(steps), 2), np.int64)
        for s, (o, i) in enumerate(steps):
            for place, f in enumerate(o):
                out[f, s] = passed if place < i else own if place == i else either
        return list(out)

    axes = "abcdefgh"[:k]
    by_step = "pm" + axes + "," + ",".join("s" + a for a in axes[::-1]) + "->pms"
    alone = [np.array([failed if f == g else passed for g in range(k)]) for f in range(k)]
    anyhow = [np.array([failed if f == g else either for g in range(k)]) for f in range(k)]
    schema = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"

    def contract(tensor: np.ndarray, chosen: list[np.ndarray]) -> np.ndarray:
        return np.einsum(by_step, tensor, *chosen, optimize=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tensor = np.zeros((b.num_rows, len(MEASURES), size), np.int64)
            for p, found in enumerate(b.column("cells").to_pylist()):
                for c in found:
                    tensor[p, :, c["cell"]] = [c[m] for m in MEASURES]
            tensor = tensor.reshape(-1, len(MEASURES), *[2] * k)  # the last axis is bit 0 of the cell
            removed, kept = contract(tensor, selectors(failed)), contract(tensor[:, :1], selectors(passed))[:, 0]
            unique = contract(tensor[:, :1], [np.stack([x[g] for x in alone]) for g in range(k)])[:, 0]
            fails = contract(tensor[:, :1], [np.stack([x[g] for x in anyhow]) for g in range(k)])[:, 0]
            shapley = np.stack([removed[:, 0, at == f].sum(axis=1) for f in range(k)], axis=1)
            many = lambda x: x.reshape(-1)
            columns = [kept, removed[:, 0], fails[:, at] - removed[:, 0], unique[:, at], removed[:, 1], removed[:, 2], shapley[:, at]]
            part = b.column("part").take(pa.array(np.repeat(np.arange(b.num_rows), len(steps))))
            order, step = np.tile(np.repeat(names, k), b.num_rows), np.tile(np.arange(1, k + 1, dtype=np.int32), len(orders) * b.num_rows)
            yield pa.RecordBatch.from_arrays([part, pa.array(order, pa.string()), pa.array(step), *(pa.array(many(c).astype(np.int64)) for c in columns)], [x.split()[0] for x in schema.split(", ")])

    # At most 32 cells for each part.
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("cell", *MEASURES)).alias("cells"))
    return parts.mapInArrow(_in_pieces(run), schema)


def _in_pieces(run):
    """A batch of many parts is worked on in slices, so a task holds the rows of PARTS parts."""

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return run(b.slice(i, PARTS) for b in batches for i in range(0, b.num_rows, PARTS))

    return sliced


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return audit(staged(cells(rows), "filter-cells"))


OP13_SQL = r"""
WITH q AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM t),
f AS (SELECT text, min(doc_id) AS first FROM t GROUP BY text),
d AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CASE WHEN len(words) < 50 THEN 1 ELSE 0 END AS a, CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 1 ELSE 0 END AS b,
    CASE WHEN 100 * length(regexp_replace(w.text, '[^A-Z]', '', 'g')) > 5 * length(w.text) THEN 1 ELSE 0 END AS c, CASE WHEN regexp_matches(w.text, '[#$%&*|]') THEN 1 ELSE 0 END AS d, CASE WHEN w.doc_id > f.first THEN 1 ELSE 0 END AS e
    FROM w JOIN f ON f.text = w.text LEFT JOIN q ON q.doc_id = w.doc_id),
n AS (SELECT part, a + 2 * b + 4 * c + 8 * d + 16 * e AS cell, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM d GROUP BY 1, 2),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (SELECT o1.l || o2.l || o3.l || o4.l || o5.l AS filter_order, [o1.bit, o2.bit, o3.bit, o4.bit, o5.bit] AS bits FROM l o1, l o2, l o3, l o4, l o5 WHERE o1.bit + o2.bit + o3.bit + o4.bit + o5.bit = 31 AND o1.bit | o2.bit | o3.bit | o4.bit | o5.bit = 31),
s AS (SELECT filter_order, step, bits[step] AS own, CAST(coalesce(list_sum(bits[1:step - 1]), 0) AS INTEGER) AS before FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
r AS (SELECT part, filter_order, step, own,
    sum(CASE WHEN cell & (before | own) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN cell & before = 0 AND cell & own <> 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN cell & before <> 0 AND cell & own <> 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN cell = own THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN cell & before = 0 AND cell & own <> 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN cell & before = 0 AND cell & own <> 0 THEN toxic ELSE 0 END) AS toxic_lost
    FROM n, s GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
    CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM r
"""
