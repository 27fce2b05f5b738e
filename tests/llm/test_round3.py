"""Spelling variants, token files and the filter audit against brute force; exact search and archives at their edges."""

import base64
import random
import re
import time
import zlib
from collections import Counter
from fractions import Fraction
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewarden.llm import filter_audit, htmltext, huffman, secrets, spelling, substring_dedup, suffix_dedup, token_files, topk, toxicity, warc

DOCS = "doc_id long, text string, source string, ids string, n long, word string, row string, part string, bits string, digest string"


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, "c", 1, "c", "c", "c", "c", "c") for r in rows], DOCS).repartition(5)


# Spelling variants ---------------------------------------------------------------------------------------------------


def spelling_by_hand(rows, every):
    count = Counter()
    for i, text, _ in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if c.isascii() else c for c in w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            count[w[: h % len(w)] + w[h % len(w) + 1 :] if h % every == 0 else w] += 1
    words = {w: n for w, n in count.items() if len(w) >= 6 and n >= 5}

    def one_edit(a, b):
        if len(a) > len(b):
            a, b = b, a
        k = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
        return a != b and (a[k:] == b[k + 1 :] or len(a) == len(b) and a[k + 1 :] == b[k + 1 :])

    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {w: m for w in words if near[w] and words[m := min(near[w], key=lambda v: (-words[v], v))] >= 5 * words[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return {(w, form.get(w), root(w), n, len(near[w]), words[form[w]] if w in form else None) for w, n in words.items()}


@pytest.mark.parametrize("symbols", ["01234567", "01", "0123456789abcdef"])
def test_spelling_variants(spark, symbols):
    r = random.Random(4)
    base = ["orange", "oranges", "ORANGE", "banana", "bananas", "grünér", "grüner", "Études", "études", "colour", "color", "colours", "colourz", "abcdef", "abcdeg", "abcdgg"]
    weights = [400, 70, 60, 300, 9, 5, 90, 5, 30, 250, 30, 40, 6, 125, 25, 5]
    text = lambda n: " ".join(r.choices(base, weights, k=n)).replace("e ", "e, ").replace("z ", "z9")
    rows = [(i, text(r.randint(0, 40)), "s") for i in range(60)] + [(60, None, "s"), (61, "", None), (None, text(30), "s"), (62, text(6000), "s"), (62, "colour", "s"), (62, "colour", "s")]
    rows.append((63, "x" * 5000 + "×÷ İstanbul", "s"))
    for every in (199, 7):
        got = [tuple(x) for x in spelling.variants(docs_of(spark, rows), every=every, symbols=symbols).select("word", "form", "root", "n", "n_near", "form_n").collect()]
        want = spelling_by_hand(rows, every)
        assert len(got) == len(want) and set(got) == want
    assert any(f and f != root for _, f, root, *_ in want)
    assert spelling.variants(docs_of(spark, rows).limit(0)).count() == 0


def test_ties_of_forms_go_to_the_smaller_word(spark):
    words = spark.createDataFrame([("planet", 5), ("planes", 50), ("plaket", 50), ("planef", 50)], "word string, n long")
    got = {x["word"]: (x["form"], x["form_n"], x["n_near"]) for x in spelling.forms(words).collect()}
    assert got == {"planet": ("plaket", 50, 3), "planes": (None, None, 2), "plaket": (None, None, 1), "planef": (None, None, 2)}


def test_roots_of_long_chains(spark):
    n = 40
    rows = [(f"w{i}", f"w{i + 1}" if i < n else None) for i in range(n + 1)] + [("alone", None)]
    got = {x["word"]: x["root"] for x in spelling.roots(spark.createDataFrame(rows, "word string, form string")).collect()}
    assert got == {**{f"w{i}": f"w{n}" for i in range(n + 1)}, "alone": "alone"}


# Token files ---------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("limit", [18, 12, 9])
def test_code_lengths_are_the_best_under_the_limit(limit):
    r = np.random.default_rng(limit)
    for n in (1, 2, 3, 17, 300):
        counts = (r.pareto(0.5, n) * 9 + 1).astype(np.int64)
        counts[r.random(n) < 0.1] = 0
        lengths = huffman.code_lengths(counts, limit)
        used = lengths[counts > 0].tolist()
        assert (lengths[counts == 0] == 0).all() and max(used, default=0) <= limit
        if len(used) > 1:
            assert sum(Fraction(1, 2**x) for x in used) == 1
            assert int((counts * lengths).sum()) == cheapest(sorted(counts[counts > 0].tolist()), limit)


def cheapest(weights, limit):
    """Package-merge with whole packages, by plain lists."""
    coins = [(w, (i,)) for i, w in enumerate(weights)]
    level = coins
    for _ in range(limit - 1):
        pairs = [(a[0] + b[0], a[1] + b[1]) for a, b in zip(level[::2], level[1::2], strict=False)]
        level = sorted(coins + pairs, key=lambda x: x[0])
    return sum(w for w, _ in level[: 2 * len(weights) - 2])


def test_blocks_decode_from_any_checkpoint():
    r = np.random.default_rng(3)
    ids = np.minimum(r.geometric(0.01, 5000), 700).astype(np.uint32)
    lengths = huffman.code_lengths(np.bincount(ids), 14)
    payload, offsets = huffman.pack(ids, huffman.canonical(lengths), lengths, 64)
    decoder = huffman.table(lengths)
    for begin, end in ((0, 5000), (0, 1), (4999, 5000), (63, 65), (640, 1281), (4000, 9000)):
        assert (huffman.unpack(payload, offsets, 5000, 64, decoder, begin, end) == ids[begin:end]).all()
    data = huffman.block(3, 7, ids, [(None, 7, 5000)], huffman.canonical(lengths), lengths, 64) + b"\n"
    assert next(huffman.blocks(memoryview(data)))[:4] == (3, 7, 5000, 64)
    for at in (0, 40, len(data) - 5):
        bad = bytearray(data)
        bad[at] ^= 1
        with pytest.raises(ValueError, match="damaged"):
            list(huffman.blocks(memoryview(bad)))


def test_parts_of_a_crc():
    r = random.Random(1)
    data = r.randbytes(5000)
    cuts = [0, 1, 700, 700, 4999, 5000]
    crc = 0
    for a, b in zip(cuts, cuts[1:], strict=False):
        crc ^= huffman.crc_shift(zlib.crc32(data[a:b]), 5000 - b)
    assert crc == zlib.crc32(data)


@pytest.fixture(scope="module")
def vocabulary():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def test_ids_of_chunks_are_ids_of_texts(vocabulary):
    t, r = token_files.ChunkIds(vocabulary, most=300), random.Random(2)
    assert t.split
    pool = [*map(chr, [*range(0, 128), 0x85, 0xA0, 0x1680, 0x2003, 0x2028, 0x202F, 0x3000, 0x200B, 0xFEFF, 0xDF, 0xE9, 0x130, 0x3A3, 0x3C2, 0x660, 0xBD, 0x2167, 0x308, 0x1F600, 0x4E2D, 0xFB01])]
    pool += [" ", " ", "<|endoftext|>", "The", "word,", "don't", "'s", "end.", "X...", "Z;,"] * 8
    for _ in range(3000):
        text = "".join(r.choices(pool, k=r.randint(0, 30)))
        assert t.ids(text).tolist() == t.whole(text)
    long = " ".join("".join(r.choices("abc", k=7)) for _ in range(300_000))
    assert t.ids(long).tolist() == t.whole(long)


def test_token_files(spark, vocabulary, tmp_path):
    t, r = token_files.ChunkIds(vocabulary), random.Random(5)
    text = lambda n: " ".join("".join(r.choices("aeinrst", k=r.randint(1, 9))) + r.choice(["", ".", ", été"]) for _ in range(n))
    rows = [(i * 3 % 101, text(r.randint(0, 60)), "s") for i in range(101)] + [(200, None, "s"), (201, "", None), (202, text(9000), "s"), (-5, text(30), "s"), (203, "# # !", "s")]
    rows += [(7, rows[0][1], "s"), (7, rows[0][1], "s"), (None, text(20), "s"), (None, None, "s")]
    docs = docs_of(spark, rows)
    path = str(tmp_path / "ids")
    got = sorted((tuple(x) for x in token_files.round_trip(docs, vocabulary, path=path, block_ids=500, step=16, part_ids=4000, per_file=3).collect()), key=lambda x: x[1])
    ids = lambda x: [*t.whole(x or ""), 2]
    want = [(i, len(ids(x)), zlib.crc32(np.array(ids(x), "<u4").tobytes())) for i, x, _ in rows]
    assert Counter((i, n, crc) for i, _, n, crc in got) == Counter(want)
    assert [i for i, *_ in got] == sorted((i for i, _, _ in rows if i is not None), key=lambda i: i) + [None, None]
    at = 0
    for _, start, n, _ in got:
        assert start == at
        at += n
    from pagewarden.llm.shared import small_batches

    with small_batches(spark, 1):
        pieces = token_files.read(spark, path).collect()
    long = sorted((x["piece"], x["ids"]) for x in pieces if x["doc_id"] == 202)
    assert len(long) > 5 and [i for _, x in long for i in x] == ids(rows[103][1])
    assert token_files.round_trip(docs.limit(0), vocabulary).count() == 0


# Filter audit --------------------------------------------------------------------------------------------------------


def audit_by_hand(rows, labels):
    docs = []
    first = {}
    for i, text, _ in rows:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    for i, text, source in rows:
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), "D": bool(re.search("[#$%&*|]", text)), "E": i is not None and i > first[text]}
        good, toxic = (any(x == i and v[k] == 1 for x, *v in labels if x is not None) for k in (0, 1))
        docs.append((source or "", {f for f, x in fails.items() if x}, good, toxic))
    out = {}
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        shapley = Counter()
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                failing = [d for d in own if f in d[1]]
                out[part, order, step] = [len(left), len(gone), len(failing) - len(gone), sum(d[1] == {f} for d in own), sum(d[2] for d in gone), sum(d[3] for d in gone)]
                shapley[f] += len(gone)
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    return {(*k, *v) for k, v in out.items()}


def test_filter_audit(spark):
    r = random.Random(6)
    word = lambda: r.choice(["alpha", "Beta", "gamma", "DELTA", "eps#ilon", "zeta", "etaé"]) + str(r.randint(0, r.choice([1, 500])))
    rows = [(i, r.choice([" ", "\t", "\n"]).join(word() for _ in range(r.choice([3, 49, 50, 51, 120]))), f"s{i % 3}") for i in range(90)]
    rows += [(200 + i, rows[i % 4][1], "s1") for i in range(40)] + [(300, None, None), (301, "", ""), (302, "É x " * 60, "s0"), (None, rows[0][1], "s0"), (None, "only here", "s0"), (5, rows[5][1], "s2"), (5, rows[5][1], "s2"), (303, "a" * 100_000, "s9")]
    labels = [(i, i % 2, (i // 2) % 2) for i in range(0, 340, 3)] + [(0, 0, 1), (None, 1, 1), (9, None, None)]
    table = spark.createDataFrame([(*x, "c", "c") for x in labels], "doc_id long, quality int, toxic int, part string, source string")
    counts = filter_audit.cells(filter_audit.judged(docs_of(spark, rows), table))
    got = [tuple(x) for x in filter_audit.audit(counts).collect()]
    want = audit_by_hand(rows, labels)
    assert len(got) == len(want) == 600 * 5 and set(got) == want
    assert filter_audit.audit(filter_audit.cells(filter_audit.judged(docs_of(spark, rows).limit(0), table))).count() == 0


# Exact search --------------------------------------------------------------------------------------------------------


def whole(x, scale=256):
    return int(np.floor(float(x) * scale)) if abs(float(x) * scale) < 2**53 else int(float(x) * scale)


def top_by_hand(rows, k=5):
    out = []
    good = [(i, [whole(x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    for q in sorted({i for i, _ in good if i % 50 == 0}):
        own = min(v for i, v in good if i == q)
        scores = sorted((-sum(a * b for a, b in zip(own, v, strict=False)), i) for i, v in good if i != q)[:k]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scores, 1)]
    return out


@pytest.mark.parametrize("large", [1.0, 1e6, 4e6, 1e12])
def test_top_k_is_exact(spark, large):
    """Scores beyond 2^53 and, in sums that cancel, beyond 2^63; ties; vectors of other lengths; clashing columns."""
    r = np.random.default_rng(1)
    rows = [(i, [large * (i % 2 or 1), *(r.integers(-9, 9, 3) / 256).tolist(), -large if i % 3 else 0.0]) for i in range(120)]
    rows = [(i, [v[0] if large < 1e12 else v[0] * (i % 50 == 0), *v[1:]]) for i, v in rows]
    rows += [(200, [1e6, 1 / 256]), (201, [1e6, 3 / 256, *[0.0] * 3000, 5.0]), (202, []), (203, None), (204, [1.0, None]), (205, [float("nan")]), (7, rows[7][1]), (300, rows[3][1]), (301, rows[3][1])]
    if large >= 1e12:
        rows = [(i, v) for i, v in rows if i not in (200, 201)]
    df = spark.createDataFrame([(i, v, 1.0, "c", 5) for i, v in rows], "vec_id long, embedding array<double>, score double, v string, rank int").repartition(3)
    try:
        want = top_by_hand(rows)
        fits = all(-(2**63) <= s < 2**63 for *_, s in want)
    except OverflowError:
        fits = False
    found = topk.top_k(df, F.col("vec_id") % 50 == 0, sample=40)
    if fits:
        assert sorted(map(tuple, found.collect())) == sorted(want)
    else:
        with pytest.raises(Exception, match="no long holds"):
            found.collect()


def test_top_k_where_the_last_bit_decides(spark):
    rows = [(0, [1e6, 1 / 256]), *((i, [1e6, i / 256]) for i in range(1, 4))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(df, F.col("vec_id") == 0).orderBy("rank").collect()
    assert [(x["vec_id"], x["score"]) for x in got] == [(i, 256000000**2 + i) for i in (3, 2, 1)]


# Archives ------------------------------------------------------------------------------------------------------------


def test_payloads_that_end_in_line_breaks(spark, tmp_path):
    """Alone, first and last of an archive, and last of one file before another."""
    ends = ["", "\r", "\n", "\r\n", "\r\n\r", "\r\n\r\n", "\r\n\r\n\r\n", "\r\r\n", "\n\r\n\r\n"]
    payloads = [x for e in ends for x in (f"<p>a</p>{e}", e, f"{e}b{e}", "x")]
    pages = list(enumerate(f"{x}" for x in payloads))
    df = spark.createDataFrame([(i, "u", h) for i, h in pages], "page_id long, url string, html string").coalesce(1)
    want = [(i, len(h), warc.base32_sha1(warc.hashlib.sha1(h.encode()))) for i, h in pages]
    for per_file in (1, 2, 3, 100):
        path = str(tmp_path / f"w{per_file}")
        warc.write_archives(df, path, per_file=per_file, least_bytes=1000)
        assert sorted((x["page_id"], x["payload_bytes"], x["payload_digest"]) for x in warc.digests(warc.read_archives(spark, path)).collect()) == want


def test_a_thousand_payloads_of_line_breaks(spark, tmp_path):
    r = random.Random(9)
    pages = [(i, "".join(r.choices("\r\n\r\na", k=r.randint(0, 12)))) for i in range(1000)]
    warc.write_archives(spark.createDataFrame([(i, "u", h) for i, h in pages], "page_id long, url string, html string").repartition(3), str(tmp_path / "w"), chunk=5, per_file=40)
    got = sorted((x["page_id"], x["payload_bytes"], x["payload_digest"]) for x in warc.digests(warc.read_archives(spark, str(tmp_path / "w"))).collect())
    assert got == [(i, len(h), warc.base32_sha1(warc.hashlib.sha1(h.encode()))) for i, h in pages]


# Time on hostile input -----------------------------------------------------------------------------------------------


@pytest.mark.parametrize("unit", ["<a ", "<", "<!--", "<a b='", "<![CDATA[", "<a>", "</a ", "<p class=\"x\" ", "<!", "> <a "])
def test_a_megabyte_of_tags_is_one_pass(unit):
    began = time.time()
    htmltext.parse("<html><body><p>x</p>" + unit * (1_000_000 // len(unit)))
    assert time.time() - began < 10


def test_tokens_are_those_of_one_expression():
    r = random.Random(11)
    units = ["<a ", "<", ">", "'", '"', "<!--", "-->", "<![CDATA[", "]]>", "</p>", "<p>", " x ", "<!", "<?", "=", "\n", "/"]
    for _ in range(3000):
        page = "".join(r.choices(units, k=r.randint(1, 14)))
        at, stop = 0, page.rfind(">") + 1
        while want := htmltext.TOKEN.search(page, at):
            got = htmltext.token(page, at, stop)
            assert got and got.span() == want.span(), page
            at = want.end()
        assert htmltext.token(page, at, stop) is None, page


def test_white_space_behind_a_key_header_is_one_pass():
    head, end = "-----BEGIN PRIVATE KEY-----", "-----END PRIVATE KEY-----"
    began = time.time()
    assert secrets.scan(f"{head}{' ' * 1_000_000}", secrets.automaton()) == []
    assert time.time() - began < 3
    key = f"{head}\r\n  {base64.b64encode(bytes(60)).decode()}\n{base64.b64encode(bytes(30)).decode()}\n{end}"
    assert [(k, a, b) for a, k, b in secrets.scan(f"é {key}", secrets.automaton()) if k == "key"] == [("key", 2, 2 + len(key))]


def test_a_job_releases_its_own_tables_alone(spark):
    from pagewarden.llm import shared

    other = shared.staged(spark.range(5), "other")
    mark = shared.staged_so_far()
    shared.staged(spark.range(6), "a")
    last = shared.staged(spark.range(7), "b")
    assert shared.release(spark, mark, keep=1) == 1 and other.count() == 5 and last.count() == 7
    assert shared.release(spark, mark) == 1 and other.count() == 5


# Columns whose names clash, long texts, and tables without rows -------------------------------------------------------


def test_columns_of_other_names_change_nothing(spark):
    """Extra columns named as what the operators make or use inside."""
    html = "<html><body><nav>menu</nav><article><p>Text {}</p></article></body></html>"
    plain = spark.createDataFrame([(i, f"http://h.test/{i}", html.format(i)) for i in range(6)], "page_id long, url string, html string")
    extra = plain.selectExpr("*", *(f"'c' AS {c}" for c in ("host", "skeleton", "text", "n_chars", "record", "digest", "total", "chunk", "body", "key", "slot", "refers_to", "file")))
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(htmltext.main_text(plain)) == rows(htmltext.main_text(extra)) and len(rows(htmltext.main_text(plain))) == 6
    typed = lambda df: rows(warc.with_types(warc.chunked(df)).select("page_id", "digest", "record_type"))
    assert typed(plain) == typed(extra)
    docs = spark.createDataFrame([(i, f"some words {i} password = secret{i}x AKIA{'Z' * 20}") for i in range(6)], "doc_id long, text string")
    more = docs.selectExpr("*", *(f"'c' AS {c}" for c in ("spans", "n_hex", "base_sha256", "score", "predicted", "y", "__id", "row", "toxic")))
    assert rows(secrets.find_secrets(docs)) == rows(secrets.find_secrets(more))
    assert secrets.redact(more).columns == more.columns and [r["text"] for r in secrets.redact(more).orderBy("doc_id").collect()] == [r["text"] for r in secrets.redact(docs).orderBy("doc_id").collect()]
    labels = spark.createDataFrame([(i, i % 2) for i in range(6)], "doc_id long, toxic int")
    model = toxicity.fit(more, labels.selectExpr("*", "'c' AS text", "'c' AS quality"))
    assert toxicity.score(more, model, "mine").select("doc_id", "mine").count() == 6


def test_long_texts_are_deduplicated_whole(spark):
    """A passage at the end of two texts of 20,000 words: found by words and by bytes."""
    r = random.Random(4)
    word = lambda: "".join(r.choices("abcdefghij", k=6))
    passage = " ".join(word() for _ in range(120))
    texts = [" ".join(word() for _ in range(20_000)) + " " + passage, passage + " " + " ".join(word() for _ in range(20_000)), word()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["doc_id"]: (x["n_words"], x["n_removed"]) for x in substring_dedup.dedup_words(docs).collect()}
    assert got == {0: (20_120, 0), 1: (20_120, 120), 2: (1, 0)}
    cut = {x["doc_id"]: (x["n_removed"], x["n_spans"]) for x in suffix_dedup.dedup_bytes(docs).collect()}
    assert cut == {0: (len(passage), 1), 1: (len(passage), 1), 2: (0, 0)}


def test_stages_without_items_or_labels(spark, tmp_path):
    """Nothing is toxic, nothing is contaminated, and every weight is 1."""
    import corpus_pipeline

    docs = spark.createDataFrame([(i, " ".join(f"w{i * k % 97}" for k in range(1, 30)), "en", f"s{i % 2}", 1) for i in range(20)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert stages["toxicity"](spark, docs, str(tmp_path)).count() == stages["decontamination"](spark, docs, str(tmp_path)).count() == 20
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert 0 < len(out) <= 20 and all(x["taken"] > 0 for x in out)
    docs.limit(0).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
