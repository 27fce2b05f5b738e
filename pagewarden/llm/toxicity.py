"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Fit: labelled rows outside the held-out fold, at most `max_train` of them (those of the smallest hash of doc_id), give
document frequencies of words and of word beginnings by label; what is frequent in toxic rows and rare elsewhere
becomes the lexicon (at most `max_lexicon` entries). Rows come in five folds: the features of one fold use the lexicon
of the others, so the trees see lexicon hits as new texts have them. Three quarters of the rows train the trees; the
last quarter fits the isotonic curve. Lexicon, trees and curve are a few tens of KB. Score: one pass over
all texts, each read whole.

Features: lexicon densities, nearness of lexicon words to a second person, capitals, punctuation, obfuscation rates.
Labels, lang, source and doc_id are never features.

Defined cases: null and empty texts have all features 0 and get the score of those; null ids are outside the held-out
fold of no row (crc32 of null is null: held_out is false); a label given twice counts as toxic if one is; without any
usable label the score is 0 for all; repeated rows repeat their result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import docs_of, staged, table

MAX_TRAIN = 20_000
MAX_LEXICON = 600
WORD = re.compile(r"[^\W\d_]+")
MIXED = re.compile(r"(?<![^\W\d_])[^\W\d_]++(?:[0-9@$*!|]++[^\W\d_]++)++")
SPACED = re.compile(r"(?<!\w)(?:[^\W\d_][ .\-_]){3,}[^\W\d_](?!\w)")
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "i", "*": ""})
# Second persons of the four languages.
SECOND = frozenset("you your yours yourself youre u ur du dich dir dein deine deinen ihr euch tu te toi ton ta tes vous votre vos ti tú usted ustedes vosotros".split())
BEGINNINGS = (4, 5, 6)
CAPITALS, SIGNS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*@^~|<>{}[]\\=+_"
N_FEATURES = 13
ROWS = "\x00rows"
FOLDS = 5
COUNTS = [f"{x}{k}" for k in range(FOLDS) for x in ("fine", "bad")]
#: Log-likelihood ratio that a lexicon entry needs: about one in 20,000 tokens passes by chance.
EVIDENCE = 10.0
#: Counts that a task holds before it sends them on, and tokens in a batch of them.
HELD, SENT = 400_000, 20_000
#: Words whose weights a task remembers: about 15 MB.
MEMO = 100_000
#: Rows that the uncalibrated curve counts for.
PRIOR = 50


def words_of(text: str) -> list[str]:
    low = text.lower()
    words = WORD.findall(low)
    words += [m.translate(LEET) for m in MIXED.findall(low)]
    words += [re.sub(r"[ .\-_]", "", m) for m in SPACED.findall(low)]
    return words


def tokens(words: list[str]) -> set[str]:
    """Words, and their beginnings with a mark that no word holds."""
    w = set(words)
    return w | {f"{x[:k]}~" for x in w for k in BEGINNINGS if len(x) > k}


class Weights(dict):
    """Weight of a word, by its own entry in the lexicon or that of a beginning, 0 for others; remembers up to MEMO words."""

    def __init__(self, lexicon: dict[str, float]):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, word: str) -> float:
        found = [self.lexicon.get(word, 0.0), *(self.lexicon.get(f"{word[:k]}~", 0.0) for k in BEGINNINGS if len(word) > k)]
        if len(self) >= MEMO:
            self.clear()
        self[word] = max(found)
        return self[word]


def features(text: str | None, weights: Weights) -> list[float]:
    if not text:
        return [0.0] * N_FEATURES
    words = words_of(text)
    n = max(1, len(words))
    value = {w: v for w in set(words) if (v := weights[w])}
    hits = [i for i, w in enumerate(words) if w in value] if value else []
    seconds = [i for i, w in enumerate(words) if w in SECOND]
    near = 0.0
    if hits and seconds:
        s = np.array(seconds)
        h = np.array(hits)
        at = np.searchsorted(s, h)
        gap = np.minimum(np.abs(s[np.minimum(at, len(s) - 1)] - h), np.abs(s[np.maximum(at - 1, 0)] - h))
        near = float((1.0 / (1.0 + gap)).max())
    weight = sum(value[words[i]] for i in hits)
    letters = sum(map(len, words)) or 1
    raw = text.encode("utf-8", "surrogatepass")
    upper = len(raw) - len(raw.translate(None, CAPITALS))
    marks = text.count("!") + text.count("?")
    signs = len(raw) - len(raw.translate(None, SIGNS))
    return [
        len(hits) / n, math.log1p(len(hits)), len({words[i] for i in hits}) / n, math.log1p(len(value)), weight / n, max(value.values(), default=0.0), near,
        len(seconds) / n, upper / letters, marks / n, signs / n, len(MIXED.findall(text)) / n, math.log1p(n),
    ]


class Trees:
    """Boosted regression trees for the logistic loss, over quantile bins, grown level by level."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, l2: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.l2 = rounds, depth, rate, bins, l2

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], 1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.edges = [np.unique(np.quantile(c[c != 0] if (c != 0).any() else c, np.linspace(0, 1, self.bins - 1))) for c in x.T]
        self.edges = [np.unique(np.append(e, 0.0)) for e in self.edges]
        b, width = self.binned(x), self.bins + 1
        p0 = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.base, self.trees = math.log(p0 / (1 - p0)), []
        f = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, np.maximum(p * (1 - p), 1e-6)
            node, splits = np.zeros(len(y), np.int64), []
            for level in range(self.depth):
                nodes = 1 << level
                feature, cut = np.zeros(nodes, np.int64), np.full(nodes, width, np.int64)
                best = np.full(nodes, 1e-6)
                for j in range(x.shape[1]):
                    at = node * width + b[:, j]
                    gs, hs = (np.bincount(at, v, nodes * width).reshape(nodes, width).cumsum(1) for v in (g, h))
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    # Both sides of a split hold a hessian of 2 or more: about twenty rows where one in ten is toxic.
                    gain = gs**2 / (hs + self.l2) + (gt - gs) ** 2 / (ht - hs + self.l2) - gt**2 / (ht + self.l2)
                    gain = np.where((hs >= 2) & (ht - hs >= 2), gain, 0.0)
                    k = gain.argmax(1)
                    better = gain[np.arange(nodes), k] > best
                    best = np.where(better, gain[np.arange(nodes), k], best)
                    feature[better], cut[better] = j, k[better]
                splits.append((feature, cut))
                node = node * 2 + (b[np.arange(len(y)), feature[node]] > cut[node])
            leaf = self.rate * np.bincount(node, g, 1 << self.depth) / (np.bincount(node, h, 1 << self.depth) + self.l2)
            self.trees.append((splits, leaf))
            f += leaf[node]
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        b, f = self.binned(x), np.full(len(x), self.base)
        for splits, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for feature, cut in splits:
                node = node * 2 + (b[np.arange(len(x)), feature[node]] > cut[node])
            f += leaf[node]
        return f


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots (score, value), to be read by interpolation."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []
    for s, v in zip(score[order].tolist(), y[order].tolist(), strict=True):
        blocks.append([v, 1.0, s, s])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, n2, _, hi = blocks.pop()
            v1, n1, lo, _ = blocks.pop()
            blocks.append([(v1 * n1 + v2 * n2) / (n1 + n2), n1 + n2, lo, hi])
    at = np.array([e for b in blocks for e in (b[2], b[3])])
    # Half a row of either label is added to every block: no curve of a finite sample ends at certainty.
    val = np.array([(b[0] * b[1] + 0.25) / (b[1] + 0.5) for b in blocks for _ in (0, 1)])
    return at, np.maximum.accumulate(val)


class Model:
    """Lexicon, trees and curve."""

    def __init__(self, lexicon: dict[str, float], trees: Trees | None, curve: tuple[np.ndarray, np.ndarray] | None):
        self.lexicon, self.trees, self.curve = lexicon, trees, curve
        self.weights = Weights(lexicon)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.trees is None or not texts:
            return np.zeros(len(texts))
        raw = self.trees.raw(np.array([features(t, self.weights) for t in texts]))
        return np.clip(np.interp(raw, *self.curve) + 1e-4 * (1 / (1 + np.exp(-raw)) - 0.5), 0.0, 1.0)


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, max_lexicon: int = MAX_LEXICON) -> Model:
    """Learns from labelled rows outside the held-out fold. Both samples that reach the driver are bounded."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    known = known.groupBy(F.col("doc_id").cast("long").alias("__id")).agg(F.max("toxic").cast("double").alias("y"))
    known = known.orderBy(F.xxhash64("__id"), "__id").limit(max_train)
    d = docs_of(docs)
    # One text for each labelled id, the least of those that share it, so no number of repeated rows makes the sample larger.
    rows = d.join(F.broadcast(known), d["doc_id"] == F.col("__id")).groupBy("__id", "y").agg(F.min("text").alias("text"))
    rows = staged(rows.select("text", "y", F.xxhash64("__id", F.lit(5)).alias("h")), "toxicity-sample")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = [Counter() for _ in COUNTS]
        n = [0] * len(COUNTS)

        def sent() -> Iterator[pa.RecordBatch]:
            keys = list(set().union(*both))
            for at in range(0, len(keys), SENT):
                some = keys[at : at + SENT]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), *(pa.array([c[x] for x in some], pa.int64()) for c in both)], ["token", *COUNTS])
            for c in both:
                c.clear()

        for b in batches:
            for t, y, h in zip(b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                k = 2 * (h % FOLDS) + (y > 0)
                both[k].update(tokens(words_of(t.as_py() or "")))
                n[k] += 1
                if sum(map(len, both)) > HELD:
                    yield from sent()
        yield from sent()
        yield pa.RecordBatch.from_arrays([pa.array([ROWS]), *(pa.array([k], pa.int64()) for k in n)], ["token", *COUNTS])

    # Every token of every labelled row is counted: what a task has of it may be fine rows alone.
    df = rows.mapInArrow(counted, "token string, " + ", ".join(f"{c} long" for c in COUNTS)).groupBy("token").agg(*(F.sum(c).alias(c) for c in COUNTS))
    bads, rows_of = sum(F.col(c) for c in COUNTS[1::2]), sum(F.col(c) for c in COUNTS)
    top = df.filter(bads >= 4).orderBy(F.col("token") != ROWS, (bads / rows_of * F.log1p(bads)).desc(), "token").limit(max_lexicon * 8).collect()
    if not top or top[0]["token"] != ROWS:
        return Model({}, None, None)

    def lexicon_of(folds: tuple[int, ...]) -> dict[str, float]:
        """Tokens whose share of toxic rows no chance explains, with their log-odds."""
        count = lambda r: (sum(r[f"bad{k}"] for k in folds), sum(r[f"fine{k}"] for k in folds))
        bad, fine = count(top[0])
        p = (bad + 0.5) / (bad + fine + 1)
        out = {}
        for r in top[1:]:
            x, y = count(r)
            q = (x + 1e-9) / (x + y + 1e-9)
            chance = x * math.log(q / p) + (y * math.log((1 - q) / (1 - p)) if y else 0.0)
            odds = math.log((x + 0.5) / (bad + 1)) - math.log((y + 0.5) / (fine + 1))
            if x >= 3 and q > p and chance >= EVIDENCE and odds >= 2.5:
                out[r["token"]] = odds
        return dict(sorted(out.items(), key=lambda x: (-x[1], x[0]))[:max_lexicon])

    lexicon = lexicon_of(tuple(range(FOLDS)))
    lexicons = [lexicon_of(tuple(k for k in range(FOLDS) if k != out)) for out in range(FOLDS)]

    def featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights = [Weights(x) for x in lexicons]
        for b in batches:
            yield pd.DataFrame({"x": [features(t, weights[h % FOLDS]) for t, h in zip(b["text"], b["h"], strict=True)], "y": b["y"], "h": b["h"]})

    sample = rows.mapInPandas(featured, "x array<double>, y double, h long").toPandas().sort_values(["h", "y"], kind="stable")
    x, y, part = np.array(sample["x"].tolist()), sample["y"].to_numpy(), (sample["h"].to_numpy() // FOLDS) % 4 == 0
    if len(set(y[~part])) < 2 or len(set(y[part])) < 2:
        part = np.zeros(len(y), bool)
    trees = Trees().fit(x[~part], y[~part])
    on = part if part.any() else ~part
    raw = trees.raw(x[on])
    at, value = isotonic(raw, y[on])
    # A curve of few rows is drawn towards the trees' own probabilities.
    return Model(lexicon, trees, (at, np.maximum.accumulate((len(raw) * value + PRIOR / (1 + np.exp(-at))) / (len(raw) + PRIOR))))


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """docs with a score column, whatever its columns are; a column of that name is replaced."""
    docs = docs.drop(name)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.append_column(name, pa.array(model.scores(b.column(b.schema.names.index("text")).to_pylist())))

    return docs.mapInArrow(each, schema)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = docs_of(table(spark, sf_dir, "documents"))
    s = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return s.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
