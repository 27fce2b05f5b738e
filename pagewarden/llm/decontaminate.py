"""Benchmark decontamination with DataFrame functions only.

Test items become a hash set of normalised word n-grams. Training texts are cut into words once; every window is
hashed, the hashes meet the set in a join, and the few hits are joined back to their rows, where each is verified word
by word against the item's own n-gram before it counts. What meets the windows is the set's hashes alone, one long
each, broadcast while their count is within `broadcast_keys`; the n-grams themselves meet only the hits, broadcast while
there are at most `broadcast_rows` of them. Beyond either count the same join is left to Spark, which shuffles both sides.

Defined cases: null and empty texts have no words and hit nothing; an item of fewer than n words, but not none, is one
window of its own length; rows repeated as a whole get the same result each; rows that share a doc_id but not the text
are judged each for itself; null ids are ids like others (null item_ids are left out of the listed items); an empty
benchmark hits nothing. A very common passage is one n-gram with many hits: hits are summed by row before anything else.
"""

from __future__ import annotations

import string
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import docs_of, row_key, table

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
N = 10
#: A row of the set is about 200 bytes in memory, so this is 40 MB at most.
BROADCAST_ROWS = 200_000
#: A hash is 8 bytes, about 30 in a broadcast relation of longs: 60 MB at most.
BROADCAST_KEYS = 2_000_000


def normal_words(text: Column) -> Column:
    """Lower-cases A-Z alone, and splits at everything that is neither a-z, 0-9 nor beyond ASCII."""
    low = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.filter(F.split(low, SEPARATORS), lambda w: w != "")


def windows(words: Column, n: int) -> Column:
    """Hashes of all windows of n words, by position."""
    starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, F.lit(n))))


def ngram_set(items: DataFrame, n: int = N) -> DataFrame:
    """(item_id, text) to distinct (item_id, len, gram array, hash)."""
    w = items.select(F.col("item_id").cast("string").alias("item_id"), normal_words(F.col("text").cast("string")).alias("w")).filter(F.size("w") > 0)
    w = w.withColumn("len", F.least(F.size("w"), F.lit(n)))
    g = w.select("item_id", "len", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - F.col("len") + 1), lambda i: F.slice(F.col("w"), i, F.col("len")))).alias("gram"))
    return g.withColumn("hash", F.xxhash64("gram")).distinct()


def hits(docs: DataFrame, items: DataFrame, n: int = N, broadcast_rows: int = BROADCAST_ROWS, keep: Iterable[str] = (), broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """Rows of docs as doc_id, text, words, hit (positions of hit words), item_ids (sorted) and row (the columns to keep).

    The lengths that items have (n, and what shorter items there are: at most n values) are read from the set.
    """
    grams = ngram_set(items, n)
    rows = {r["len"]: r["rows"] for r in grams.groupBy("len").agg(F.count(F.lit(1)).alias("rows")).collect()}
    small = sum(rows.values()) <= broadcast_rows
    few = sum(rows.values()) <= broadcast_keys
    keys = grams.select("hash").distinct()
    d = docs_of(docs, F.struct(*[F.col(c) for c in keep] or [F.lit(0)]).alias("row")).withColumn("__k", row_key(F.col("doc_id"), F.col("text")))
    w = d.select("__k", normal_words(F.col("text")).alias("w"))
    found = None
    for size in sorted(rows):
        one = w.select("__k", F.posexplode(windows(F.col("w"), size)).alias("at", "hash")).withColumn("len", F.lit(size))
        found = one if found is None else found.unionByName(one)
    if found is None:
        none = F.array().cast("array<string>")
        return d.select("doc_id", "text", "row", normal_words(F.col("text")).alias("words"), F.array().cast("array<int>").alias("hit"), none.alias("item_ids"))
    at = found.join(F.broadcast(keys) if few else keys, "hash", "left_semi")
    # An n-gram's hash and place say all: the items follow from the hash, once for each row and n-gram.
    by_row = at.groupBy("__k", "hash", "len").agg(F.collect_set("at").alias("ats"))
    with_items = by_row.join(F.broadcast(grams) if small else grams, ["hash", "len"])
    cand = with_items.groupBy("__k").agg(F.collect_list(F.struct("item_id", "len", "gram", "ats")).alias("cand"))
    j = d.join(cand, "__k", "left").withColumn("words", normal_words(F.col("text")))
    true_ats = F.transform(
        F.coalesce("cand", F.array().cast(cand.schema["cand"].dataType)),
        lambda c: F.struct(c["item_id"].alias("item_id"), c["len"].alias("len"), F.filter(c["ats"], lambda a: F.slice(F.col("words"), a + 1, c["len"]) == c["gram"]).alias("ats")),
    )
    j = j.withColumn("cand", F.filter(true_ats, lambda c: F.size(c["ats"]) > 0))
    hit = F.array_distinct(F.flatten(F.transform("cand", lambda c: F.flatten(F.transform(c["ats"], lambda a: F.sequence(a, a + c["len"] - 1))))))
    ids = F.array_sort(F.array_distinct(F.filter(F.transform("cand", lambda c: c["item_id"]), lambda x: x.isNotNull())))
    return j.select("doc_id", "text", "row", "words", hit.alias("hit"), ids.alias("item_ids"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return h.select(
        "doc_id", F.size("words").cast("long").alias("n_words"), F.size("hit").cast("long").alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.size("hit") > 0).alias("contaminated"),
    )


OP4_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS k,
    list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM benchmark),
b2 AS (SELECT item_id, w, least(len(w), 10) AS n FROM b WHERE len(w) > 0),
g AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i+n-1], ' ') AS gram FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM b2)),
lens AS (SELECT DISTINCT n FROM g),
win AS (SELECT k, n, i, array_to_string(w[i:i+n-1], ' ') AS gram FROM (SELECT k, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
h AS (SELECT k, item_id, i, win.n FROM win JOIN g ON win.n = g.n AND win.gram = g.gram),
pos AS (SELECT k, count(DISTINCT p) AS n_hit FROM (SELECT k, unnest(range(i, i + n)) AS p FROM h) GROUP BY k),
its AS (SELECT k, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM h GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
    sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (k) LEFT JOIN its USING (k)
"""
