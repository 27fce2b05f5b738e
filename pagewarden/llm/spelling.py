"""Groups of spelling variants: words one edit apart, each pointing at a much more frequent one.

Words are counted over all texts; those long and frequent enough are the vocabulary. Every letter is hashed to one of a
few symbols, so a word has a short-alphabet form, its reduced word, and words one edit apart have reduced words at most
one edit apart. Each word generates the full one-edit neighbourhood of its reduced word over the few symbols (itself, its
deletions, replacements and insertions: some (2k + 1)(n + 1) strings for n letters and k symbols, where the real alphabet
would give thousands), these meet the reduced words of the vocabulary in a join of hashes, and what meets is verified on
the original strings. Each direction is generated, so a word has all its near words without a union of mirrored pairs.

All joins are hinted to sort and merge: the vocabulary grows with the input, and a broadcast of it passes the driver.

`roots` follows forms by pointer jumping on staged tables. A form is at least `ratio` times as frequent, so chains end.

Defined cases: a null or empty text has no words; a null doc_id is the empty string in what is hashed; repeated rows
count each; ties of a form's count go to the smaller word by code point; an empty table gives no rows; texts of any
length are read whole; columns other than doc_id and text are not read. Words that are near each other's reduced words
by a chance of hashing fail the check and leave nothing.
"""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import docs_of, staged, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN = f"[A-Za-z{chr(0xC0)}-{chr(0xFF)}]+"
LETTERS = LOWER + "".join(map(chr, range(0xC0, 0x100)))
SYMBOLS = "01234567"


def damaged(doc_id: Column, run: Column, every: int = 199) -> Column:
    """The run, or, where `every` divides the hash of document and run, the run without one code point."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run))
    at = (h % F.length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.substr(run, F.lit(1), at), F.substr(run, at + 2))).otherwise(run)


def vocabulary(docs: DataFrame, least_length: int = 6, least_count: int = 5, every: int = 199) -> DataFrame:
    """(word, n) of the words of at least that length and count; sums are made in the scan's tasks first."""
    runs = docs_of(docs).select("doc_id", F.explode(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(RUN), F.lit(0))).alias("run"))
    words = runs.filter(F.length("run") >= least_length).select(damaged(F.col("doc_id"), F.col("run"), every).alias("word"))
    return words.filter(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


def reduced(word: Column, symbols: str = SYMBOLS) -> Column:
    """The word with every letter hashed to a symbol."""
    return F.translate(word, LETTERS, "".join(symbols[zlib.crc32(c.encode()) % len(symbols)] for c in LETTERS))


def neighbourhood(word: Column, symbols: str = SYMBOLS) -> Column:
    """All strings at most one edit from a string over the symbols, each once."""
    n, each = F.length(word), F.array(*map(F.lit, symbols))
    before = lambda i: F.substr(word, F.lit(1), i - 1)  # noqa: E731  positions count from 1
    deleted = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(before(i), F.substr(word, i + 1)))
    replaced = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(each, lambda c: F.concat(before(i), c, F.substr(word, i + 1)))))
    inserted = F.flatten(F.transform(F.sequence(F.lit(1), n + 1), lambda i: F.transform(each, lambda c: F.concat(before(i), c, F.substr(word, i)))))
    return F.array_distinct(F.concat(F.array(word), deleted, replaced, inserted))


def near_words(words: DataFrame, symbols: str = SYMBOLS) -> DataFrame:
    """(word, n, near, near_n) for every ordered pair of words that one edit makes equal."""
    w = words.select("word", "n", reduced(F.col("word"), symbols).alias("r"))
    asked = w.select("word", "n", F.explode(neighbourhood(F.col("r"), symbols)).alias("r")).select("word", "n", F.xxhash64("r").alias("key"))
    there = w.select(F.col("word").alias("near"), F.col("n").alias("near_n"), F.xxhash64("r").alias("key"))
    return asked.hint("merge").join(there, "key").filter("word <> near").filter(F.levenshtein("word", "near", 1) == 1).select("word", "n", "near", "near_n")


def forms(words: DataFrame, ratio: int = 5, symbols: str = SYMBOLS) -> DataFrame:
    """(word, n, form, form_n, n_near): the most frequent near word, if it is `ratio` times as frequent at least."""
    by = F.struct(-F.col("near_n"), F.encode("near", "UTF-8"), F.col("near"))
    best = near_words(words, symbols).groupBy("word").agg(F.count("*").alias("n_near"), F.min(by).alias("best")).select("word", "n_near", (-F.col("best.col1")).alias("near_n"), F.col("best.near").alias("near"))
    j = words.hint("merge").join(best, "word", "left")
    clear = F.col("near_n") >= ratio * F.col("n")
    return j.select("word", "n", F.when(clear, F.col("near")).alias("form"), F.when(clear, F.col("near_n")).alias("form_n"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"))


def roots(found: DataFrame) -> DataFrame:
    """Adds root: the end of a word's chain of forms. A round halves what is left of every chain."""
    at = staged(found.filter("form IS NOT NULL").select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        up = at.select(F.col("word").alias("root"), F.col("root").alias("__up"))
        at = staged(at.hint("merge").join(up, "root", "left").select("word", F.coalesce("__up", "root").alias("root"), F.col("__up").isNotNull().alias("moved")), "spelling-roots")
        if not at.filter("moved").limit(1).count():
            return found.hint("merge").join(at.select("word", "root"), "word", "left").withColumn("root", F.coalesce("root", "word"))
        at = at.select("word", "root")


def variants(docs: DataFrame, least_length: int = 6, least_count: int = 5, every: int = 199, ratio: int = 5, symbols: str = SYMBOLS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the vocabulary."""
    words = staged(vocabulary(docs, least_length, least_count, every), "spelling-words")
    found = staged(forms(words, ratio, symbols), "spelling-forms")
    return roots(found).select("word", "form", "root", "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))
