"""Substring dedup over words, by suffix automata of reference shards.

The reference of a document is every document of a smaller id, so the reference grows with the corpus and an automaton
of all of it could not be broadcast. `spans.repeated` files text under content-defined anchors; a shard is what one
anchor's distinct regions hold, bounded in number. The shard's automaton goes to the task that has the shard's regions,
where they are streamed through it for matching statistics, cut to `length` words: the state of the last `length`
words tells the smallest doc_id in which they occur. Words are compared as words, never as hashes, in the automaton.
An anchor of more than GROUP distinct regions takes the counted-windows way of `spans.repeated`, which is exact too.

Defined cases: null and empty texts have no words and lose none; a null doc_id counts as larger than all others; rows
of the same doc_id never remove one another's words; repeated rows get the same result each; documents of fewer than
`length` words lose none; very long texts are handled whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import docs_of, row_keys, table
from .spans import BODY, MN, Runs, merged, repeated

LENGTH = 50
GRAM = 20
#: Distinct regions of one anchor in one automaton: 160,000 words, about 130 MB of states.
GROUP = 2048


class Automaton:
    """Suffix automaton of several word sequences; every state knows the smallest rank of a sequence it occurs in."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length, self.rank = [-1], [0], [1 << 63]

    def _state(self, length: int, nxt: dict, link: int) -> int:
        self.next.append(nxt)
        self.link.append(link)
        self.length.append(length)
        self.rank.append(1 << 63)
        return len(self.link) - 1

    def _split(self, p: int, w: bytes, q: int) -> int:
        """The state of p's strings followed by w, cut off from q."""
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def add(self, words: list[bytes], rank: int) -> None:
        last = 0
        for w in words:
            q = self.next[last].get(w)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, w, q)
            else:
                new = self._state(self.length[last] + 1, {}, 0)
                p = last
                while p >= 0 and w not in self.next[p]:
                    self.next[p][w] = new
                    p = self.link[p]
                if p >= 0:
                    q = self.next[p][w]
                    self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
                last = new
            if rank < self.rank[last]:
                self.rank[last] = rank

    def close(self) -> Automaton:
        """Hands ranks on to shorter suffixes."""
        for v in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            p = self.link[v]
            if self.rank[v] < self.rank[p]:
                self.rank[p] = self.rank[v]
        return self

    def ranks(self, words: list[bytes], length: int) -> Iterator[int]:
        """For each window of `length` words, the smallest rank in which it occurs (1 << 63 if in none)."""
        v = size = 0
        nxt, link, longest, rank = self.next, self.link, self.length, self.rank
        for i, w in enumerate(words):
            while v and w not in nxt[v]:
                v = link[v]
                size = longest[v]
            if w in nxt[v]:
                v = nxt[v][w]
                size += 1
            while link[v] >= 0 and longest[link[v]] >= length:
                v = link[v]
                size = longest[v]
            if i >= length - 1:
                yield rank[v] if size >= length else 1 << 63


def solve(groups: list[list[tuple]]) -> Runs:
    for regions in groups:
        automaton = Automaton()
        bodies = [r[BODY].split() for r in regions]
        for r, body in zip(regions, bodies, strict=True):
            automaton.add(body, r[MN])
        automaton.close()
        for r, body in zip(regions, bodies, strict=True):
            runs: list[tuple[int, int, int]] = []
            for s, m in enumerate(automaton.ranks(body, LENGTH)):
                if runs and runs[-1][1] == s and runs[-1][2] == m:
                    runs[-1] = (runs[-1][0], s + 1, m)
                else:
                    runs.append((s, s + 1, m))
            yield r, runs


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out: list[list] = [[], [], [], []]
        for doc_id, text, cover in zip(*b.columns, strict=True):
            words = text.as_buffer().to_pybytes().split() if text.is_valid else []
            kept, at = [], 0
            for s, e in merged(cover.as_py()):
                kept += words[at:s]
                at = e
            kept += words[at:]
            for c, v in zip(out, (doc_id.as_py(), len(words), len(words) - len(kept), b" ".join(kept)), strict=True):
                c.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept"])


def dedup_words(docs: DataFrame, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """(doc_id, text) to doc_id, n_words, n_removed, kept (the words that stay, joined by one space)."""
    d = docs_of(docs)
    d = d.select(*row_keys(F.col("doc_id"), F.col("text")), F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("rank"), "doc_id", "text")
    covered = repeated(d, LENGTH, gram, True, solve, by_rank=True, group=group)
    return covered.select("doc_id", "text", "cover").mapInArrow(_keep, "doc_id long, n_words long, n_removed long, kept string")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_words(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS k, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT k, doc_id, i, md5(array_to_string(w[i:i+49], ' ')) AS h FROM (SELECT k, doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
f AS (SELECT h, min(doc_id) AS first_id FROM win GROUP BY h),
gone AS (SELECT DISTINCT k, unnest(range(i, i + 50)) AS p FROM win JOIN f USING (h) WHERE first_id < doc_id),
g AS (SELECT k, list(p) AS ps FROM gone GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
    sha256(array_to_string(CASE WHEN ps IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(ps, i)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN g USING (k)
"""
