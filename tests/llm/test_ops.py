"""The training-data operators on small tables with every odd case, against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pagewarden.llm import decontaminate, htmltext, jaccard_join, mixing, secrets, shared, substring_dedup, suffix_dedup, topk, toxicity, warc

SCHEMA = "doc_id long, text string, source string, lang string, words string, hash string, key string"


def odd_docs(spark, n=60, seed=1):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = " ".join(r.choice(vocabulary) for _ in range(90))
    rows = []
    for i in range(n):
        text = " ".join(r.choice(vocabulary) for _ in range(r.randint(1, 150)))
        if i % 4 == 0:
            text = f"{text} {passage} {text[:50]}"
        if i % 9 == 1 and rows[-1][1]:
            text = rows[-1][1] + " tail"
        rows.append((i, text, f"s{i % 3}"))
    rows += [(n, None, "s0"), (n + 1, "", None), (n + 2, rows[4][1], "s1"), (n + 3, "é" * 900, "s2"), (n + 4, " ".join(["same"] * 200), "s2"), rows[4], rows[4], (None, rows[8][1], "s0"), (n + 5, "\t a  b\nc \x0b", "s1")]
    return spark.createDataFrame([(*x, "en", "clash", "clash", "clash") for x in rows], SCHEMA)


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def same(got, want):
    assert Counter(map(tuple, got)) == Counter(map(tuple, want))


@pytest.mark.parametrize("group", [2048, 1])
def test_substring_dedup(spark, group):
    docs = odd_docs(spark)
    data = [(i, (t or "").encode().split()) for i, t in rows_of(docs)]
    rank = lambda i: (1 << 63) - 1 if i is None else i
    first: dict = {}
    for i, w in data:
        for s in range(len(w) - 49):
            k = tuple(w[s : s + 50])
            first[k] = min(first.get(k, rank(i)), rank(i))
    want = []
    for i, w in data:
        gone = {p for s in range(len(w) - 49) if first[tuple(w[s : s + 50])] < rank(i) for p in range(s, s + 50)}
        want.append((i, len(w), len(gone), b" ".join(x for p, x in enumerate(w) if p not in gone).decode()))
    got = substring_dedup.dedup_words(docs, group=group).collect()
    same(got, want)
    assert sum(r["n_removed"] for r in got) > 0


@pytest.mark.parametrize("group", [20_000, 1])
def test_suffix_dedup(spark, group):
    docs = odd_docs(spark)
    data = [(i, (t or "").encode()) for i, t in rows_of(docs)]
    want = [(i, len(t), *x) for (i, t), x in zip(data, repeated_bytes([t for _, t in data]), strict=True)]
    same([(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffix_dedup.dedup_bytes(docs, group=group).collect()], want)


def around_a_core(n, core, pad, seed=3):
    """n texts of one core between random letters: one anchor for most windows, n regions."""
    r = random.Random(seed)
    some = lambda: "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=pad))
    return [some() + core + some() for _ in range(n)]


def repeated_bytes(texts):
    """(removed bytes, spans, kept) of each text by counting every 400-byte window."""
    count = Counter(t[s : s + 400] for t in texts for s in range(len(t) - 399))
    out = []
    for t in texts:
        mark = bytearray(len(t))
        for s in range(len(t) - 399):
            if count[t[s : s + 400]] > 1:
                mark[s : s + 400] = b"\1" * 400
        out.append((sum(mark), len([x for x in bytes(mark).split(b"\0") if x]), bytes(b for b, m in zip(t, mark, strict=True) if not m)))
    return out


@pytest.mark.parametrize("n", [6, 300, 3000])
def test_regions_of_one_anchor(n):
    core = around_a_core(1, "", 250)[0]
    bodies = sorted({x.encode() for x in around_a_core(n, core, 20)})
    group = [(1, k, 0, b, len(b) - 399, 100, 1 + (k == 2), 0) for k, b in enumerate(bodies)]
    other = [(2, k, 0, b[5:480], 76, 95, 1, 0) for k, b in enumerate(bodies[:2])]
    got = {(r[0], r[1]): [(a, b) for a, b, _ in x] for r, x in suffix_dedup.solve([group, other])}
    for g in (group, other):
        for r, want in zip(g, suffix_dedup.by_bytes(g), strict=True):
            assert {i for a, b in got.get((r[0], r[1]), []) for i in range(a, b)} == {i for i, _ in want}


def test_equal_hashes_of_different_bytes_remove_nothing(monkeypatch):
    """With a hash that tells nothing apart, the comparison of bytes decides."""
    import numpy as np

    bodies = [x.encode() for x in around_a_core(5, around_a_core(1, "", 220)[0], 20)]
    group = [(1, k, 0, b, len(b) - 399, 60, 1, 0) for k, b in enumerate(bodies)]
    want = [(r[1], [(x[0][0], x[-1][1])]) for r, x in zip(group, suffix_dedup.by_bytes(group), strict=True)]
    monkeypatch.setattr(suffix_dedup.Suffixes, "hash", lambda self, a, b: np.zeros(len(a), np.uint64))
    assert [(r[1], [(a, b) for a, b, _ in x]) for r, x in suffix_dedup.solve([group])] == want


def test_hot_anchor_in_one_task_and_counted(spark):
    texts = around_a_core(1500, around_a_core(1, "", 230)[0], 30)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    want = [(i, *x) for i, x in enumerate(repeated_bytes([t.encode() for t in texts]))]
    for group in (4096, 1000):
        same([(r["doc_id"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffix_dedup.dedup_bytes(docs, group=group).collect()], want)


def test_hot_words_in_one_task_and_counted(spark):
    r = random.Random(8)
    word = lambda: r.choice("abcdefghijklmnop")
    core = [f"c{k}" for k in range(60)]
    data = [(i, [word() for _ in range(12)] + core + [word() for _ in range(12)]) for i in range(1200)]
    docs = spark.createDataFrame([(i, "  ".join(w)) for i, w in data], "doc_id long, text string").repartition(6)
    first: dict = {}
    for i, w in data:
        for s in range(len(w) - 49):
            first.setdefault(tuple(w[s : s + 50]), i)
    want = []
    for i, w in data:
        gone = {p for s in range(len(w) - 49) if first[tuple(w[s : s + 50])] < i for p in range(s, s + 50)}
        want.append((i, len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    for group in (2048, 500):
        same([(x["doc_id"], x["n_removed"], x["kept"]) for x in substring_dedup.dedup_words(docs, group=group).collect()], want)


def shingles(text):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate({65 + i: 97 + i for i in range(26)}))
    return {tuple(w[s : s + 5]) for s in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


@pytest.mark.parametrize(("close", "bucket", "hot"), [(100, 100_000, 50_000), (0, 100_000, 50_000), (100, 1, 50_000), (0, 100_000, 2), (100, 1, 1)])
def test_jaccard_components(spark, close, bucket, hot):
    docs = odd_docs(spark, 40)
    data = [(i, shingles(t)) for i, t in rows_of(docs)]
    parent = list(range(len(data)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in range(len(data)):
        for y in range(x):
            a, b = data[x][1], data[y][1]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                parent[find(x)] = find(y)
    want = []
    for x, (i, s) in enumerate(data):
        ids = [data[y][0] for y in range(len(data)) if find(y) == find(x) and data[y][0] is not None]
        want.append((i, len(s), min(ids) if s and ids else i))
    same(jaccard_join.near_duplicates(docs, bucket=bucket, close=close, hot=hot).collect(), want)
    if (close, bucket) != (100, 100_000):
        return
    kept = jaccard_join.keep_one(docs)
    empties = len({(i, len(s)) for i, s in data if not s})
    assert kept.columns == docs.columns
    assert len({find(x) for x in range(len(data)) if data[x][1]}) + empties == kept.count()


def test_decontamination(spark):
    docs = odd_docs(spark)
    texts = [t for _, t in rows_of(docs) if t]
    items = spark.createDataFrame([(1, texts[0].upper()), (2, "A b C"), (3, None), (4, "..."), (None, texts[4]), (10, texts[4][5:80])], "item_id long, text string")
    cut = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({65 + i: 97 + i for i in range(26)})) if w]
    grams = {}
    for i, t in [(r["item_id"], cut(r["text"])) for r in items.collect()]:
        n = min(len(t), 10)
        for s in range(len(t) - n + 1 if t else 0):
            grams.setdefault(tuple(t[s : s + n]), set()).add(i)
    want = []
    for i, t in rows_of(docs):
        w, hit, ids = cut(t), set(), set()
        for n in {len(g) for g in grams}:
            for s in range(len(w) - n + 1):
                if (g := tuple(w[s : s + n])) in grams:
                    hit |= set(range(s, s + n))
                    ids |= grams[g]
        want.append((i, len(w), tuple(sorted(hit)), tuple(sorted(str(x) for x in ids if x is not None))))
    for rows, hashes in ((200_000, 2_000_000), (0, 2_000_000), (0, 0)):
        got = decontaminate.hits(docs, items, broadcast_rows=rows, keep=docs.columns, broadcast_keys=hashes)
        same([(r["doc_id"], len(r["words"]), tuple(sorted(r["hit"])), tuple(r["item_ids"])) for r in got.collect()], want)
    assert decontaminate.hits(docs, items.limit(0)).count() == docs.count()


def test_mixing(spark):
    docs = odd_docs(spark, 200)
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (None, 1)], "doc_id long, quality int")
    got = mixing.mix(docs, labels).collect()
    assert len(got) == docs.count() and sorted(map(str, got)) == sorted(map(str, mixing.mix(docs, labels).collect()))
    size, target, taken, most = Counter(), {}, Counter(), Counter()
    for r in got:
        assert r["size"] == len(re.findall("[^\x20\x09-\x0d]+", r["text"] or "")) and r["taken"] <= 3 * r["size"]
        size[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        most[r["source"]] = max(most[r["source"]], r["size"])
    assert sum(target.values()) == pytest.approx(sum(size.values()))
    for s in size:
        assert target[s] <= 3 * size[s] + 1e-6 and abs(taken[s] - target[s]) <= most[s]


def test_targets_stop_at_the_cap(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 5), ("d", 0), (None, 100)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(mixing.source_weights(sizes)).collect()}
    left = 1115 - 30 - 15 - 300
    assert got["a"] == 30 and got["c"] == 15 and got["d"] == 0 and got[None] == pytest.approx(300) and got["b"] == pytest.approx(left)


def test_secrets(spark):
    body = "A" * 30
    x, tail = zlib.crc32(body.encode()), ""
    while x:
        x, k = divmod(x, 62)
        tail = secrets.BASE62.decode()[k] + tail
    token = f"ghp_{body}{tail.rjust(6, '0')}"
    texts = ["é password = 'hunter22x' and token:abc", "AKIA" + "Z" * 16, "ſecret=abcdefgh", "0" * 30, f"x {token} y", token[:-1] + "!", None, "", "secretsecret = abcdefgh"]
    base = [(k, p) for k, p in (("assign", r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), ("access", "AKIA[A-Z0-9]+"), ("hex", "[0-9a-f]+"))]
    got = secrets.find_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in got:
        t, spans_ = texts[r["doc_id"]] or "", []
        for k, p in base:
            for m in re.finditer(p, t):
                if (len(m[2]) >= 6 if k == "assign" else len(m[0]) >= (20 if k == "access" else 24)):
                    spans_.append((m.start(), ["assign", "access", "hex"].index(k), f"{k}:{m.start()}:{m.end()}"))
        assert r["base_sha256"] == hashlib.sha256(",".join(s[2] for s in sorted(spans_)).encode()).hexdigest()
    assert [r["spans"] for r in got if r["doc_id"] == 4] == [f"forge:2:{2 + len(token)}"] and all("forge" not in r["spans"] for r in got if r["doc_id"] == 5)
    assert secrets.masked("a password=hunter22 b", secrets.automaton()) == "a [SECRET] b"


def test_warc_round_trip(spark, tmp_path):
    pages = [(1, "u", "<p>" + "é" * 3000), (2, None, "<p>" + "é" * 3000), (3, "v", None), (4, "w", ""), (5, "x\r\ny", "a\r\n\r\nWARC/1.1\r\n\r\nb"), (5, "x", "other"), (None, "n", "<p>" + "é" * 3000), (2, None, "<p>" + "é" * 3000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    path = str(tmp_path / "w")
    warc.write_archives(df, path, chunk=701, per_file=4)
    got = warc.digests(warc.read_archives(spark, path)).collect()
    last: dict = {}
    for i, _, h in pages:
        last[h or ""] = max(last.get(h or "", -1), -1 if i is None else i)
    want = []
    for i, _, h in pages:
        raw = (h or "").encode()
        own = i == last[h or ""]
        want.append((i, len(raw), warc.base32_sha1(hashlib.sha1(raw)), "response" if own else "revisit", None if own else last[h or ""]))
    same(got, want)


def test_top_k(spark):
    r = random.Random(5)
    vectors = [(i, [r.uniform(-1, 1) for _ in range(8)]) for i in range(300)] + [(301, None), (302, [1.0, None]), (303, [float("nan")]), (7, [0.5] * 8), (None, [1.0]), (304, []), (305, [0.25, 0.5])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    import numpy as np

    ints = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in vectors if i is not None and v is not None and all(x is not None and x == x for x in v)]
    want = []
    for q in sorted({i for i, _ in ints if i % 50 == 0}):
        v = min(x for i, x in ints if i == q)
        s = sorted((-sum(a * b for a, b in zip(v, x, strict=False)), i) for i, x in ints if i != q)[:5]
        want += [(q, k + 1, i, -score) for k, (score, i) in enumerate(s)]
    from pyspark.sql import functions as F

    for block in (4096, 2):
        same(topk.top_k(df, F.col("vec_id") % 50 == 0, block=block).collect(), want)
    assert topk.top_k(df.limit(0), F.lit(True)).count() == 0


def page(article, menu, k):
    return f'<html><body><div class="top"><ul>{menu}</ul></div><div class="note">All rights &amp; more</div><article><h1>T {k}</h1>{article}<div class="comments"><p>me too</p></div></article><aside>side {k}</aside><form>q</form><footer>f {k}</footer></body></html>'


def test_main_text(spark):
    links = "".join(f'<li><a href="/{i}">link number {i}</a></li>' for i in range(5))
    rows = [(k, f"http://h.org/{k}", page(f"<p>one  {k}<br>two<p>three &lt; <b>four", links, k)) for k in range(5)]
    rows += [(6, None, None), (7, "http://lone.org/", "<body><nav>n</nav><p>only <script>x()</script> text</p>"), (8, "bad", "plain &amp; simple"), (0, rows[0][1], rows[0][2])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for most in (16_000_000, 0):
        got = {(r["page_id"], r["text"], r["n_chars"]) for r in htmltext.main_text(df, most).collect()}
        want = {k: f"T {k}\none {k} two\nthree < four" for k in range(5)} | {6: "", 7: "only text", 8: "plain & simple"}
        assert got == {(k, t, len(t)) for k, t in want.items()}


def test_constant_blocks_go_whatever_the_first_page_is(spark):
    one = lambda k: f"<body><div class=c1><div>Welcome to all</div></div><div class=c2><div>The text {k} of one</div><div>All is constant here</div></div><div class=c3>Rights kept</div></body>"
    two = lambda k: f"<body><table><tr><td>Old layout</td></tr></table><div class=b><div>Another text {k}</div></div><div class=z>Made long ago</div></body>"
    html = ["<body><pre>404: not here</pre></body>"] + [one(k) for k in range(1, 6)] + [two(k) for k in range(6, 10)]
    df = spark.createDataFrame([(k, f"http://h.org/{k}", x) for k, x in enumerate(html)], "page_id long, url string, html string")
    want = {0: "404: not here"} | {k: f"The text {k} of one" for k in range(1, 6)} | {k: f"Another text {k}" for k in range(6, 10)}
    for most in (16_000_000, 0):
        assert {r["page_id"]: r["text"] for r in htmltext.main_text(df, most).collect()} == want


def test_nodes_that_no_reference_has_are_slots_by_path(spark):
    # Each page has a skeleton of its own, and more of them than there are references.
    html = [f"<body><div class=a>{''.join(f'<div class=v{chr(97 + j)}><p>Text {k} {j}</p></div>' for j in range(k, k + 2))}</div>{'<section>Same on all</section>' if k else ''}</body>" for k in range(9)]
    df = spark.createDataFrame([(k, f"http://h.org/{k}", x) for k, x in enumerate(html)], "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in htmltext.main_text(df).collect()} == {k: f"Text {k} {k}\nText {k} {k + 1}" for k in range(9)}


def test_names_of_anchors_keep_article_text():
    body = (
        '<header id="top"><h1>Title</h1></header><div class="article-header"><h2 id="related-work">Related work</h2></div><section id="discussion"><p>We talk</p></section>'
        '<p id="legal-basis">Law <math><mi>x</mi><annotation>\\x</annotation></math></p><div class="header">Part</div><div class="big Comments">me too</div><div role="search">find</div><ul class="share">s</ul><p hidden>h</p><nav>n</nav>'
    )
    for tag in ("article", "main"):
        page = f'<body><header>site</header><div id="legal-notes">l</div><{tag}>{body}</{tag}></body>'
        assert htmltext.extract(page, "#", {}) == "Title\nRelated work\nWe talk\nLaw x\nPart"


def test_tree_matching_keeps_order():
    assert htmltext.aligned("a(b c d)", "a(b d)") == (0, 1, -1, 2) and htmltext.aligned("x", "y") == (-1,)


def nested(text):
    """A written skeleton as (label, kids), with the number of each node in preorder."""
    count = iter(range(10**6))

    def read(tokens):
        out = []
        while tokens and tokens[0] != ")":
            node = (tokens.pop(0), next(count), [])
            if tokens and tokens[0] == "(":
                tokens.pop(0)
                node[2].extend(read(tokens))
                tokens.pop(0)
            out.append(node)
        return out

    return read(re.findall(r"[^\s()]+|[()]", text))[0]


def most_pairs(x, y):
    """Simple tree matching as it is defined."""
    if x[0] != y[0]:
        return 0
    best = [[0] * (len(y[2]) + 1) for _ in range(len(x[2]) + 1)]
    for i, a in enumerate(x[2]):
        for j, b in enumerate(y[2]):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + most_pairs(a, b))
    return best[-1][-1] + 1


@pytest.mark.parametrize("cells", [1 << 21, 4])
def test_tree_matching_is_the_largest(monkeypatch, cells):
    monkeypatch.setattr(htmltext, "CELLS", cells)
    htmltext.aligned.cache_clear()
    r = random.Random(cells)

    def tree(depth):
        kids = [tree(depth - 1) for _ in range(r.randint(0, 4) if depth else 0)]
        return r.choice("ab") + (f"({' '.join(kids)})" if kids else "")

    for _ in range(150):
        one, other = (f"r({tree(3)} {tree(3)} {tree(2)})" for _ in range(2))
        got = htmltext.aligned(one, other)
        a, b = nested(one), nested(other)
        assert sum(x >= 0 for x in got) == most_pairs(a, b)

        def check(x, y):
            assert x[0] == y[0] and got[x[1]] == y[1]
            under = {n[1]: k for k, n in enumerate(y[2])}
            met = [(n, got[n[1]]) for n in x[2] if got[n[1]] >= 0]
            assert [under[m] for _, m in met] == sorted({under[m] for _, m in met})
            for n, m in met:
                check(n, y[2][under[m]])

        check(a, b)


def test_deep_and_wide_pages(spark):
    deep = lambda k, n=100_000: f"<body>{'<div>' * n}<p>text {k}</p>{'</div>' * n}{'</em>' * 1000}"
    wide = lambda k, n=25_000: f"<body>{''.join(f'<div>x{k} {i}</div><section>y</section>' for i in range(n))}<aside>no</aside>"
    rows = [(k, "http://deep.org/", deep(k, 100_000 - k)) for k in range(3)] + [(k, "http://wide.org/", wide(k, 25_000 - 3 * k)) for k in range(3, 5)]
    got = {r["page_id"]: r["text"] for r in htmltext.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[k] for k in range(3)] == [f"text {k}" for k in range(3)]
    assert all(got[k].startswith(f"x{k} 0\ny\nx{k} 1\n") and got[k].count("\n") == 2 * (25_000 - 3 * k) - 1 for k in (3, 4))


def test_toxicity(spark):
    r = random.Random(2)
    fine, bad = [f"w{i}" for i in range(300)], ["moron", "clown", "scum"]
    rows, labels = [], []
    for i in range(900):
        words = [r.choice(fine) for _ in range(40)]
        if i % 6 == 0:
            for _ in range(3):
                words.insert(r.randint(0, 40), r.choice(bad))
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 6 == 0)))
    rows += [(1000, None), (1001, ""), (None, "moron")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int"))
    got = {x["doc_id"]: x["score"] for x in toxicity.score(docs, model).collect()}
    out = [i for i in range(900) if zlib.crc32(str(i).encode()) % 5 == 0]
    right = sum((got[i] >= 0.5) == (i % 6 == 0) for i in out) / len(out)
    assert right > 0.97 and 0 <= got[1000] == got[1001] < 0.5
    empty = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {x["score"] for x in toxicity.score(docs, empty).collect()} == {0.0}


def test_toxicity_model_is_the_same_for_any_partitions(spark):
    r = random.Random(4)
    fine, bad = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)], ["moron", "clown", "scum"]
    rows, labels = [], []
    for i in range(600):
        words = [r.choice(fine) for _ in range(40)] + ([r.choice(bad) for _ in range(3)] if i % 6 == 0 else [])
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 6 == 0)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    one, many = (toxicity.fit(docs.repartition(n), labels) for n in (1, 200))
    assert set(one.lexicon) & set(bad) == set(bad) and not set(one.lexicon) & set(fine)
    assert one.lexicon == many.lexicon
    texts = [t for _, t in rows]
    assert one.scores(texts).tolist() == many.scores(texts).tolist()


def test_empty_tables(spark, tmp_path):
    none = odd_docs(spark).limit(0)
    assert substring_dedup.dedup_words(none).count() == suffix_dedup.dedup_bytes(none).count() == jaccard_join.near_duplicates(none).count() == 0
    assert jaccard_join.keep_one(none).count() == mixing.mix(none).count() == secrets.find_secrets(none).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert htmltext.main_text(pages).count() == 0
    warc.write_archives(pages, str(tmp_path / "w"))
    assert warc.digests(warc.read_archives(spark, str(tmp_path / "w"))).count() == 0
    items = spark.createDataFrame([("a", "b c d")], "item_id string, text string")
    assert decontaminate.hits(none, items).count() == 0
    model = toxicity.fit(none, spark.createDataFrame([(1, 1)], "doc_id long, toxic int"))
    assert toxicity.score(none, model).count() == 0 and model.scores(["x", None]).tolist() == [0.0, 0.0]


def test_records_point_at_records(spark, tmp_path):
    """Ids of revisits and of segments are ids of records that are there, and each of the format's fields is where it belongs."""
    pages = [(k, f"u{k}", "<p>" + "ab\r\n\r\n" * n) for k, n in ((1, 5), (2, 900), (3, 5), (4, 900), (5, 400), (None, 5))]
    path = str(tmp_path / "w")
    warc.write_archives(spark.createDataFrame(pages, "page_id long, url string, html string"), path, chunk=1000)
    pieces = [r["value"].encode() + warc.END for r in spark.read.option("lineSep", "\r\n\r\n").text(path).collect()]
    heads = [h for h, _ in warc.blocks(iter(pieces))]
    by_id = {h["WARC-Record-ID"]: h for h in heads}
    assert len(by_id) == len(heads) and Counter(h["WARC-Type"] for h in heads) == {"response": 3, "revisit": 3, "continuation": 7}
    for h in heads:
        if h["WARC-Type"] == "revisit":
            assert by_id[h["WARC-Refers-To"]]["WARC-Type"] == "response"
        if h["WARC-Type"] == "continuation":
            assert by_id[h["WARC-Segment-Origin-ID"]]["WARC-Segment-Number"] == "1" and int(h["WARC-Segment-Number"]) > 1
    last = [h for h in heads if "WARC-Segment-Total-Length" in h]
    assert len(last) == 2 and all(h["WARC-Type"] == "continuation" for h in last)


def test_a_damaged_archive_fails(spark, tmp_path):
    warc.write_archives(spark.createDataFrame([(1, "u", "abc")], "page_id long, url string, html string"), str(tmp_path / "w"))
    text = [r["value"] for r in spark.read.option("lineSep", "\r\n\r\n").text(str(tmp_path / "w")).collect()]
    bad = spark.createDataFrame([(t.replace("abc", "abd"),) for t in text], "value string").coalesce(1)
    bad.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(str(tmp_path / "b"))
    with pytest.raises(Exception, match="payload digest differs"):
        warc.digests(warc.read_archives(spark, str(tmp_path / "b"))).collect()


def test_repeated_labelled_rows_are_one_sample(spark):
    rows = [(i, f"some words {i % 7} here") for i in range(60)] + [(1, "some words 1 here")] * 500 + [(1, "another text of that id")] * 500
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    once = spark.createDataFrame([*rows[:60], (1, "another text of that id")], "doc_id long, text string")
    texts = [t for _, t in rows[:80]]
    assert toxicity.fit(docs, labels).scores(texts).tolist() == toxicity.fit(once, labels).scores(texts).tolist()


@pytest.mark.parametrize("equal", ["key", "key2"])
@pytest.mark.parametrize("group", [4096, 1])
def test_rows_of_one_hash_keep_their_own_cuts(spark, monkeypatch, equal, group):
    """Where one of a row's two hashes is the same for all rows, the other alone tells them apart, in every join."""
    docs = odd_docs(spark)
    want = [dedup(docs, group=group).collect() for dedup in (substring_dedup.dedup_words, suffix_dedup.dedup_bytes)]
    whole = shared.row_keys
    one = lambda i, t: tuple(F.lit(7).cast("long").alias(n) if n == equal else c for n, c in zip(("key", "key2"), whole(i, t), strict=True))
    for module in (substring_dedup, suffix_dedup):
        monkeypatch.setattr(module, "row_keys", one)
    got = [dedup(docs, group=group).collect() for dedup in (substring_dedup.dedup_words, suffix_dedup.dedup_bytes)]
    for g, w in zip(got, want, strict=True):
        same([tuple(map(str, r)) for r in g], [tuple(map(str, r)) for r in w])
        assert sum(r["n_removed"] for r in g) > 0
