"""Token ids of a corpus as compressed binary files, and back.

Write: texts are tokenised where they lie and the ids staged, once; counts of ids by task are summed by id. The counts
(a row for each id that occurs, so bounded by the vocabulary) give one canonical length-limited Huffman code for the
corpus (`huffman.py`). A range shuffle puts documents in ascending order of doc_id; each range is a part, cut into
blocks of `block_ids` ids, and Spark's text writer writes the blocks as bytes, a line break after each, in files of at
most `per_file` blocks whose names ascend with doc_id. The codebook is a file of its own, one length a symbol.

Read: files are read whole (their size is bounded), their blocks decoded by table from bit-offset checkpoints. A
document may lie in several blocks and files: each piece gives the part of the CRC-32 that is its own, and the pieces'
exclusive or is the document's.

Ids do not reach across white space, so a task remembers the ids of the chunks between it; a chunk not seen before is
tokenised by the library. A chunk of ASCII letters with closing marks behind is two pieces to tokenizers that split
letters from marks; whether this one does is probed when it is loaded.

Defined cases: a null or empty text has the end id alone; a null doc_id comes last; rows of one doc_id are ordered by
text hash, and repeated rows follow each other; an empty table writes a codebook and no block; a text of any length is
cut into blocks; other columns are not read.
"""

from __future__ import annotations

import re
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import huffman
from .shared import docs_of, shared_dir, small_batches, staged, table

BLOCK_IDS = 1 << 16
STEP = 64
#: Blocks of a file: some 25 MB, which a reader holds in memory.
PER_FILE = 256
#: Ids of a part; ranges of documents of about this size are written by a task each.
PART_IDS = 1 << 24
#: Parts at most: beyond it parts grow, since a shuffle has blocks for each pair of task and part. A part sorts by spilling.
MOST_PARTS = 20_000
CHARS = 1 << 20
CLOSING = ".,;:!?"
#: White space to Python but not to tokenizers.
SEPARATORS = re.compile("[\x1c-\x1f]")
WHITE = "".join(map(chr, [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
CHUNK = re.compile(f"[^{WHITE}]+")


class _Slots(dict):
    """Numbers chunks in the order in which they are first asked for."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, chunk: str) -> int:
        self[chunk] = n = len(self)
        self.new.append(chunk)
        return n


class ChunkIds:
    """Ids of texts, through remembered ids of their chunks."""

    def __init__(self, path: str, most: int = 800_000) -> None:
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.letters: dict[str, tuple[int, ...]] = {}
        self.split = self._splits()
        self.reset()

    def reset(self) -> None:
        self.slots, self.kept = _Slots(), 0
        if len(self.letters) > self.most:
            self.letters = {}
        self.flat, self.ends = array("I"), array("q", [0])

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _splits(self) -> bool:
        """Whether lower-case letters go to the model as they are, and closing marks and case change nothing in them."""
        model = lambda w: [t.id for t in self.tokenizer.model.tokenize(w)]
        probes = [*"abcdefghijklmnopqrstuvwxyz", "the", "information", "qzxv", "thntingnd", "aeiouy" * 5]
        return all(self.whole(w + m) == self.whole(w.title() + m) == model(w) + (self.whole(m) if m else []) for w in probes for m in ("", ".", ",", "?!", "...", ":;"))

    def _new(self, chunk: str) -> list[int]:
        if self.split:
            letters = chunk.rstrip(CLOSING)
            if letters.isascii() and letters.isalpha():
                low = letters.lower()
                ids = self.letters.get(low)
                if ids is None:
                    ids = self.letters[low] = tuple(t.id for t in self.tokenizer.model.tokenize(low))
                return [*ids, *self._marks(chunk[len(letters) :])] if len(letters) < len(chunk) else list(ids)
        return self.whole(chunk)

    def _marks(self, marks: str) -> tuple[int, ...]:
        ids = self.letters.get(marks)
        if ids is None:
            ids = self.letters[marks] = tuple(self.whole(marks))
        return ids

    def ids(self, text: str) -> np.ndarray:
        found, at = [], 0
        while at < len(text):
            end = text.find(" ", at + CHARS) if len(text) - at > CHARS else -1
            part = text[at : end if end >= 0 else len(text)]
            at = end if end >= 0 else len(text)
            chunks = CHUNK.findall(part) if SEPARATORS.search(part) else part.split()
            if len(self.slots) > self.most or self.kept > 16 * self.most:
                self.reset()
            slots = np.fromiter(map(self.slots.__getitem__, chunks), np.int64, len(chunks))
            for chunk in self.slots.new:
                self.flat.extend(self._new(chunk))
                self.ends.append(len(self.flat))
                self.kept += len(chunk)
            self.slots.new.clear()
            ends, flat = np.frombuffer(self.ends, np.int64), np.frombuffer(self.flat, np.uint32)
            sizes = ends[slots + 1] - ends[slots]
            begins = np.repeat(ends[slots] - (np.cumsum(sizes) - sizes), sizes)
            found.append(flat[begins + np.arange(len(begins))])
            del ends, flat
        return np.concatenate(found) if found else np.zeros(0, np.uint32)


_LOADED: dict[str, ChunkIds] = {}


def _loaded(path: str) -> ChunkIds:
    """One for each worker, which outlives a task."""
    if path not in _LOADED:
        _LOADED[path] = ChunkIds(path)
    return _LOADED[path]


def tokenize(docs: DataFrame, vocabulary: str, end_id: int = 2) -> DataFrame:
    """(doc_id, tie, row, n, ids): ids as little-endian unsigned integers of 2 or 4 bytes (`id_type`), the end id last."""
    kind = id_type(vocabulary, end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, end = _loaded(vocabulary), np.array([end_id], np.uint32)
        for b in batches:
            ids = [np.concatenate([tokenizer.ids(t.as_py() or ""), end]) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("tie"), b.column("row"), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.astype(kind).tobytes() for x in ids], pa.binary())], ["doc_id", "tie", "row", "n", "ids"])

    d = docs_of(docs).select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie"), F.monotonically_increasing_id().alias("row"))
    return d.mapInArrow(run, "doc_id long, tie long, row long, n long, ids binary")


def id_type(vocabulary: str, end_id: int) -> str:
    from tokenizers import Tokenizer

    return "<u2" if max(Tokenizer.from_file(vocabulary).get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"


def counts(tokens: DataFrame, kind: str) -> np.ndarray:
    """How often each id occurs: summed in each task, then by id; a row for each id that occurs reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for b in batches:
            c = np.bincount(np.frombuffer(b"".join(b.column(0).to_pylist()), kind), minlength=len(total))
            c[: len(total)] += total
            total = c
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(total[found], pa.int64())], ["id", "n"])

    found = tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(int(max(found["id"].to_numpy(), default=-1)) + 1, np.int64)
    out[found["id"].to_numpy()] = found["n"].to_numpy()
    return out


def _write_blocks(kind: str, lengths: np.ndarray, block_ids: int, step: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, codes = TaskContext.get().partitionId(), huffman.canonical(lengths)
        first, held, size, docs = 0, [], 0, []  # ids before the block, its ids so far, their number, its documents
        row = lambda: pa.RecordBatch.from_arrays([pa.array([huffman.block(part, first, np.concatenate(held), docs, codes, lengths, step)], pa.binary())], ["block"])
        for b in batches:
            for doc_id, x in zip(b.column("doc_id"), b.column("ids"), strict=True):
                ids = np.frombuffer(x.as_py(), kind)
                doc, at = (doc_id.as_py(), first + size, len(ids)), 0
                while at < len(ids):
                    some = ids[at : at + block_ids - size]
                    held.append(some)
                    docs.append(doc)
                    size, at = size + len(some), at + len(some)
                    if size == block_ids:
                        yield row()
                        first, held, size, docs = first + size, [], 0, []
        if size:
            yield row()

    return run


def write(tokens: DataFrame, path: str, kind: str, max_length: int = 18, block_ids: int = BLOCK_IDS, step: int = STEP, part_ids: int = PART_IDS, per_file: int = PER_FILE) -> None:
    """Writes what `tokenize` gave (staged: it is read several times) under path: `codebook` and `blocks`."""
    spark = tokens.sparkSession
    n = counts(tokens, kind)
    lengths = huffman.code_lengths(n, max_length)
    _bytes(spark.createDataFrame([(bytearray(lengths.tobytes()),)], "block binary").coalesce(1)).text(f"{path}/codebook")
    order = [F.col("doc_id").asc_nulls_last(), F.col("tie").asc(), F.col("row").asc()]
    every = int(n.sum())
    parts = max(1, min(spark.sparkContext.defaultParallelism, -(-every // block_ids)), min(-(-every // part_ids), MOST_PARTS))
    rows = tokens.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "ids")
    with small_batches(spark):
        _bytes(rows.mapInArrow(_write_blocks(kind, lengths, block_ids, step), "block binary"), per_file).text(f"{path}/blocks")


def _bytes(df: DataFrame, per_file: int = 0):
    """A writer of the column `block`: the text sink writes a string's bytes as they are."""
    return df.select(F.col("block").cast("string").alias("value")).write.option("maxRecordsPerFile", per_file).option("lineSep", "\n")


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "part-*").load(path).select("content")


def codebook(spark: SparkSession, path: str) -> np.ndarray:
    """Code lengths of all ids: a byte for each."""
    return np.frombuffer(bytes(_files(spark, f"{path}/codebook").head()[0])[:-1], np.uint8)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(part, doc_start, doc_id, n_doc, piece, n, ids): the pieces of documents that lie in one block.

    doc_start: ids of the part before the document; piece: ids of the document before the piece. Give Arrow batches of
    few rows (`small_batches`) while this runs: a row of the scan is a file.
    """
    schema = "part long, doc_start long, doc_id long, n_doc long, piece long, n long, ids array<long>"
    return _files(spark, f"{path}/blocks").mapInArrow(_pieces(codebook(spark, path), lambda x: x.astype(np.int64)), schema)


def digests(spark: SparkSession, path: str) -> DataFrame:
    """The same without ids, with crc: what the piece's ids, as 4 bytes each, add to the CRC-32 of its document."""
    schema = "part long, doc_start long, doc_id long, n_doc long, piece long, n long, crc long"
    return _files(spark, f"{path}/blocks").mapInArrow(_pieces(codebook(spark, path), None), schema)


def _pieces(lengths: np.ndarray, ids_of: Callable | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = ["part", "doc_start", "doc_id", "n_doc", "piece", "n", "ids" if ids_of else "crc"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = huffman.table(lengths)
        for b in batches:
            for content in b.column(0):
                for part, first, n, step, docs, has, starts, sizes, offsets, payload in huffman.blocks(memoryview(content.as_buffer())):
                    ids = huffman.unpack(payload, offsets, n, step, decoder)
                    begins, ends = np.maximum(starts, first) - first, np.minimum(starts + sizes, first + n) - first
                    data, last = ids.astype("<u4"), []
                    for a, e, after in zip(begins.tolist(), ends.tolist(), (starts + sizes - first - ends).tolist(), strict=True):
                        last.append(ids_of(data[a:e]) if ids_of else huffman.crc_shift(zlib.crc32(data[a:e]), 4 * after))
                    columns = [np.full(len(docs), part), starts, np.ma.array(docs, mask=has == 0), sizes, begins + first - starts, ends - begins]
                    yield pa.RecordBatch.from_arrays([*(pa.array(c.astype(np.int64), pa.int64()) for c in columns), pa.array(last, pa.list_(pa.int64()) if ids_of else pa.int64())], names)

    return run


def documents(pieces: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of what `digests` gave, staged. start counts the ids of all parts before."""
    by = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = pieces.groupBy("part").agg(F.sum("n").alias("all")).select("part", F.coalesce(F.sum("all").over(by), F.lit(0)).alias("before"))
    whole = pieces.filter("n = n_doc").select("part", "doc_start", "doc_id", "n", "crc")
    cut = pieces.filter("n < n_doc").groupBy("part", "doc_start", "doc_id").agg(F.sum("n").alias("n"), F.bit_xor("crc").alias("crc"))
    return whole.unionByName(cut).join(parts, "part").select("doc_id", (F.col("before") + F.col("doc_start")).alias("start"), F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))


def round_trip(docs: DataFrame, vocabulary: str, end_id: int = 2, path: str | None = None, **options: int) -> DataFrame:
    """Tokenises docs, writes the files under path (a new folder beside the staged tables, if None) and reads them back."""
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark).rstrip('/')}/token-files-{uuid.uuid4().hex}"
    write(staged(tokenize(docs, vocabulary, end_id), "token-ids", codec="zstd"), path, id_type(vocabulary, end_id), **options)
    return documents(staged(digests(spark, path), "token-pieces", rows=1))


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
