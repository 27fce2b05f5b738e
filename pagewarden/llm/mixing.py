"""Mixing sources to target weights, with DataFrame functions only.

Every source gets a token target from its weight (water filling under a cap of `max_epochs` times its size). A source
whose target is e whole sizes and a rest takes every document e times; the rest is filled by Efraimidis-Spirakis
sampling without replacement: a document of quality weight w draws u in (0, 1) from a hash of its content and gets the
exponential key -ln(u) / w; documents are taken in order of that key until their prefix sum reaches the rest.

The prefix sums are two-level histograms of the key instead of one ordered window for each source: a window over a
source that holds a third of the corpus would be one task. Sums by (source, bucket) find the bucket in which the rest
runs out; only its documents are split again, and only what falls in that one sub-bucket is ordered.

Defined cases: a null or empty text has size 0 and is taken 0 times; a null source is a source of its own, ordered
last; null or non-positive weights count as 1; repeated rows are rows of their own that draw the same key; an empty
table gives an empty result; a source of size 0 has target 0. Columns other than the five named are kept by `mix`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import staged, table

BUCKETS = 4096
#: A row of the plan is about 200 bytes in memory, so this is 10 MB at most.
BROADCAST_ROWS = 50_000
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, max_epochs: float = 3.0) -> DataFrame:
    """(source, source_size, weight) to the same with `target`: weights share the total, nobody gets above its cap.

    A source is at its cap when cap / weight is below the level the others reach. In order of cap / weight the capped
    sources are a prefix, so running sums give the level. The table has a row for each source.
    """
    cap = F.col("source_size") * F.lit(float(max_epochs))
    order = Window.orderBy(cap / F.col("weight"), F.col("rank"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).orderBy(F.lit(1))
    level = (F.col("all_size") - F.col("cap_before")) / (F.col("all_weight") - F.col("weight_before"))
    w = (
        sizes.withColumn("cap", cap)
        .withColumn("all_size", F.sum("source_size").over(everything).cast("double"))
        .withColumn("all_weight", F.sum("weight").over(everything))
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("weight_before", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", level)
        .withColumn("open", F.col("cap") > F.col("level") * F.col("weight"))
        .withColumn("final", F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("weight"), F.col("rank"), F.col("level")))).over(everything))
    )
    return w.select("source", "rank", "source_size", "weight", F.coalesce(F.least(F.col("cap"), F.col("final.level") * F.col("weight")), F.col("cap")).alias("target"))


def source_weights(sizes: DataFrame, cycle: tuple[float, ...] = (1.0, 2.0, 3.0)) -> DataFrame:
    """Ranks sources by code point, null last, and gives them the weights of `cycle` in turn."""
    by = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    ranked = sizes.withColumn("rank", F.row_number().over(by))
    pick = F.element_at(F.array(*[F.lit(float(x)) for x in cycle]), ((F.col("rank") - 1) % len(cycle) + 1).cast("int"))
    return ranked.withColumn("weight", pick)


def _tag(source: Column) -> Column:
    """A join key in which a null source equals itself alone."""
    return F.concat(F.when(source.isNull(), "n").otherwise("s"), F.coalesce(source.cast("string"), F.lit("")))


def _boundary(sums: DataFrame, keys: list[str], bucket: str, need: str) -> DataFrame:
    """Of (keys, bucket, words) and the words still needed: the bucket where they run out, and what lies before it."""
    w = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, 0)
    ran = sums.withColumn("upto", F.sum("words").over(w))
    return ran.filter((F.col("upto") >= F.col(need)) & (F.col("upto") - F.col("words") < F.col(need)) & (F.col(need) > 0)).select(
        *keys, F.col(bucket).alias(f"{bucket}_edge"), (F.col("upto") - F.col("words")).alias(f"{bucket}_before")
    )


def _epochs() -> Column:
    """Whole sizes in the target, and the rest; rests of less than half a word are none."""
    e = F.when(F.col("source_size") > 0, F.floor(F.round(F.col("target") / F.col("source_size"), 9))).otherwise(0).cast("long")
    rest = F.col("target") - e * F.col("source_size")
    return F.struct(e.alias("e"), F.when(rest < 0.5, 0.0).otherwise(rest).alias("rest"))


def mix(docs: DataFrame, labels: DataFrame | None = None, cycle: tuple[float, ...] = (1.0, 2.0, 3.0), max_epochs: float = 3.0, seed: int = 17, keep: list[str] | None = None, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """All rows of docs with size, source_size, target and taken (words taken, repeats counted).

    labels: (doc_id, quality), from which documents get their weights; without it all weights are 1.
    keep: the columns to carry (all, if None). Sizes and draws are computed in the scan, so without `text` in it the
    texts cross no shuffle; what follows reads a staged table three times. The plan has a row for each source and is
    broadcast when there are at most `broadcast_rows` sources.
    """
    own = [c for c in (docs.columns if keep is None else keep) if c not in ("size", "source_size", "target", "taken")]
    text = F.coalesce(F.col("text"), F.lit(""))
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit("|"), text)), 1, 13), 16, 10).cast("double")
    b = docs.select(
        *own,
        *([] if "source" in own else ["source"]),
        *([] if "doc_id" in own else ["doc_id"]),
        F.xxhash64(text).alias("__t"),
        word_count(F.col("text")).alias("size"),
        _tag(F.col("source")).alias("__s"),
        ((draw + 1.0) / float(16**13 + 2)).alias("__u"),
    )
    b = with_quality(b, labels) if labels is not None else b.withColumn("__q", F.lit(1.0))
    # 1 - exp(-key) is monotone in the key and lies in (0, 1); its upper digits are the bucket, the next ones the sub-bucket.
    flat = 1.0 - F.exp(-F.col("__key"))
    b = b.withColumn("__key", -F.log("__u") / F.col("__q")).withColumn("__b", F.least(F.floor(flat * BUCKETS), F.lit(BUCKETS - 1)).cast("int"))
    b = staged(b.withColumn("__c", F.least(F.floor((flat * BUCKETS - F.floor(flat * BUCKETS)) * BUCKETS), F.lit(BUCKETS - 1)).cast("int")).drop("__u", "__q"), "mix")

    sums = staged(b.groupBy("__s", "__b").agg(F.sum("size").alias("words"), F.first("source").alias("source")), "mix-sums")
    sizes = sums.groupBy("__s").agg(F.sum("words").alias("source_size"), F.first("source").alias("source"))
    plan = targets(source_weights(sizes.select("source", "source_size"), cycle), max_epochs)
    plan = plan.select(_tag(F.col("source")).alias("__s"), "source_size", "target", _epochs().alias("__p")).select("*", F.col("__p.e").alias("__e"), F.col("__p.rest").alias("__rest")).drop("__p")
    plan = staged(plan, "mix-targets")
    small = plan.count() <= broadcast_rows
    sent = F.broadcast if small else (lambda x: x)
    plan = staged(plan.join(_boundary(sums.join(sent(plan), "__s"), ["__s"], "__b", "__rest"), "__s", "left"), "mix-plan")
    at_edge = b.select("__s", "__b", "__c", "size").join(sent(plan.select("__s", F.col("__b_edge").alias("__b"), (F.col("__rest") - F.col("__b_before")).alias("__need"))), ["__s", "__b"])
    sub = at_edge.groupBy("__s", "__c").agg(F.sum("size").alias("words"), F.first("__need").alias("__need"))
    plan = staged(plan.join(_boundary(sub, ["__s"], "__c", "__need"), "__s", "left"), "mix-plan")
    at, edge = F.struct("__b", "__c"), F.struct(F.col("__b_edge"), F.col("__c_edge"))
    j = b.join(sent(plan), "__s", "left")
    j = j.withColumn("__in", F.coalesce((F.col("__b") == F.col("__b_edge")) & (F.col("__c") == F.col("__c_edge")), F.lit(False))).withColumn("__sure", F.coalesce(F.col("__b_edge").isNotNull() & (at < edge), F.lit(False)))
    order = Window.partitionBy("__s", "__b", "__c").orderBy("__key", F.col("doc_id").asc_nulls_last(), "__t").rowsBetween(Window.unboundedPreceding, -1)
    hot = j.filter("__in").withColumn("__before", F.coalesce(F.sum("size").over(order), F.lit(0)))
    left = F.col("__rest") - F.col("__b_before") - F.col("__c_before") - F.col("__before")
    hot = hot.withColumn("__sure", (left > 0) & (left * 2 >= F.col("size"))).drop("__before")
    out = j.filter(~F.col("__in")).unionByName(hot)
    taken = (F.coalesce(F.col("__e"), F.lit(0)) + F.col("__sure").cast("long")) * F.col("size")
    return out.select(*own, "size", "source_size", F.coalesce("target", F.lit(0.0)).alias("target"), taken.cast("long").alias("taken"))


def with_quality(docs: DataFrame, labels: DataFrame, good: float = 2.0, poor: float = 0.5) -> DataFrame:
    """Adds `__q`: `good` and `poor` for labelled quality 1 and 0, 1 without a label; of an id's labels the best counts.

    Labels grow with the corpus, so both sides are shuffled at every size.
    """
    best = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("__id")).agg(F.max("quality").alias("__quality"))
    j = docs.join(best.hint("merge"), docs["doc_id"].cast("long") == F.col("__id"), "left")
    return j.withColumn("__q", F.when(F.col("__quality") == 1, good).when(F.col("__quality") == 0, poor).otherwise(1.0)).drop("__id", "__quality")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs, table(spark, sf_dir, "labels"), keep=["doc_id"]).select("doc_id", "size", "source_size", "target", "taken")


OP1_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, CAST(len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size FROM documents),
q AS (SELECT doc_id, max(quality) AS quality FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, source_size * CAST(3 AS DOUBLE) AS cap, CAST((rank - 1) % 3 + 1 AS DOUBLE) AS weight FROM (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM s)),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0)) AS level FROM w WINDOW o AS (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT arg_min(level, row(cap / weight, rank)) AS final FROM l WHERE cap > level * weight),
t AS (SELECT source, source_size, coalesce(least(cap, final * weight), cap) AS target FROM l, f),
e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(round(target / source_size, 9)) AS BIGINT) ELSE 0 END AS epochs FROM t),
r AS (SELECT *, CASE WHEN target - epochs * source_size < 0.5 THEN 0 ELSE target - epochs * source_size END AS rest FROM e),
k AS (SELECT d.doc_id, d.source, size, t, -ln((CAST('0x' || left(md5('17|' || coalesce(CAST(d.doc_id AS VARCHAR), '-') || '|' || t), 13) AS BIGINT) + 1.0) / CAST(4503599627370498 AS DOUBLE)) / CASE quality WHEN 1 THEN 2.0 WHEN 0 THEN 0.5 ELSE 1.0 END AS key
    FROM d LEFT JOIN q ON q.doc_id = d.doc_id),
b AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id NULLS LAST, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM k)
SELECT doc_id, size, source_size, target, CAST((epochs + CASE WHEN rest - before > 0 AND (rest - before) * 2 >= size THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM b JOIN r ON b.source IS NOT DISTINCT FROM r.source
"""
