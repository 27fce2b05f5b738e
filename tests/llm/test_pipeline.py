"""The pipeline's stages on the smallest tables: what goes, what stays, what each returns."""

import hashlib
import math
import re
from collections import Counter

import pytest

import corpus_pipeline
from pagewarden.llm import decontaminate, jaccard_join, secrets, toxicity
from pagewarden.llm.shared import staged, table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = table(spark, SF, "documents"), []
    for name, f in corpus_pipeline.STAGES:
        out.append((name, docs, staged(f(spark, docs, SF), "test")))
        docs = out[-1][2]
    return out


def test_order_and_columns(stages):
    assert [n for n, _, _ in stages] == ["toxicity", "near duplicates", "decontamination", "secrets", "mixing"]
    for _, before, after in stages[:-1]:
        assert before.columns == after.columns and after.count() <= before.count()


def test_decisions_take_effect(spark, stages):
    _, _, unique = stages[1]
    left = jaccard_join.near_duplicates(unique)
    assert left.filter("component_id <> doc_id").count() == 0
    assert decontaminate.hits(stages[2][2], table(spark, SF, "benchmark")).filter("size(hit) > 0").count() == 0
    assert stages[3][1].count() == stages[3][2].count()
    assert secrets.find_secrets(stages[3][2]).filter("spans <> ''").count() == 0
    assert stages[4][2].filter("taken <= 0 or taken > 3 * size").count() == 0


def test_clean_documents_stay(stages):
    """Rows that no stage has a reason to touch reach the mix unchanged."""
    docs = {r["doc_id"]: r["text"] for r in stages[0][2].collect()}
    after = {r["doc_id"]: r["text"] for r in stages[3][2].collect()}
    assert len(after) > 0.7 * len(docs) and sum(after[i] == docs[i] for i in after) > 0.95 * len(after)


LOW = {65 + i: 97 + i for i in range(26)}


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def shingles(text):
    w = words((text or "").translate(LOW))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain_words(text):
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW)) if w]


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_stages_by_plain_python(spark, stages):
    """Each stage's rule, applied by brute force to what the stage got."""
    _, before, after = stages[0]
    model = toxicity.fit(before, table(spark, SF, "labels"))
    rows = texts(before)
    fine = [x for x, s in zip(rows, model.scores([t for _, t in rows]), strict=True) if s < 0.5]
    assert Counter(fine) == Counter(texts(after))

    _, before, after = stages[1]
    rows = sorted(set(texts(before)))
    sets, group = [shingles(t) for _, t in rows], list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]) and group[i] != group[j]:
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    assert Counter(x for x, g, s, i in zip(rows, group, sets, range(len(rows)), strict=True) if g == i or not s) == Counter(texts(after))

    _, before, after = stages[2]
    grams = set()
    for r in table(spark, SF, "benchmark").collect():
        w = plain_words(r["text"])
        n = min(10, len(w))
        grams |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
    sizes = {len(g) for g in grams}
    clean = lambda w: not any(tuple(w[i : i + n]) in grams for n in sizes for i in range(len(w) - n + 1))
    assert Counter(x for x in texts(before) if clean(plain_words(x[1]))) == Counter(texts(after))

    _, before, after = stages[3]
    rx = re.compile(r"""(?ai)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6,}|AKIA[A-Z0-9]{16,}|[0-9a-f]{24,}""")
    changed = dict(texts(after))
    assert all(changed[i] == t or rx.search(t) or "PRIVATE KEY" in t or "gh" in t for i, t in texts(before))
    assert sum(changed[i] != t for i, t in texts(before)) == sum(r["spans"] != "" for r in secrets.find_secrets(before).collect())

    _, before, after = stages[4]
    quality: dict = {}
    for r in table(spark, SF, "labels").filter("doc_id is not null and quality is not null").collect():
        quality[r["doc_id"]] = max(quality.get(r["doc_id"], 0), r["quality"])
    docs, size = before.collect(), Counter()
    for r in docs:
        size[r["source"]] += len(words(r["text"]))
    weight = {s: 1.0 + k % 3 for k, s in enumerate(sorted(size, key=lambda s: (s is None, s or "")))}
    target, left, open_ = {}, float(sum(size.values())), set(size)
    while True:  # give out by weight, cap at three times the size, give out the rest again
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if 3 * size[s] < level * weight[s]}
        if not over:
            break
        for s in over:
            target[s] = 3.0 * size[s]
        left -= sum(target[s] for s in over)
        open_ -= over
    target |= {s: level * weight[s] for s in open_}

    def key(r):
        u = (int(hashlib.md5(f"17|{r['doc_id']}|{r['text']}".encode()).hexdigest()[:13], 16) + 1) / (16**13 + 2)
        return -math.log(u) / {1: 2.0, 0: 0.5, None: 1.0}[quality.get(r["doc_id"])]

    want, seen = {}, Counter()
    for r in sorted(docs, key=key):
        s, n = r["source"], len(words(r["text"]))
        epochs = math.floor(round(target[s] / size[s], 9)) if size[s] else 0
        rest = target[s] - epochs * size[s] - seen[s]
        want[r["doc_id"]] = (epochs + (rest > 0 and 2 * rest >= n)) * n
        seen[s] += n
    got = {r["doc_id"]: (r["taken"], r["target"]) for r in after.collect()}
    assert {i: n for i, n in want.items() if n} == {i: n for i, (n, _) in got.items()}
    assert all(t == pytest.approx(target[r["source"]]) for r in docs if r["doc_id"] in got for t in [got[r["doc_id"]][1]])


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score double, words string"


def run_on(spark, tmp_path, rows):
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, 1, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([("b1", "one two three four five six seven eight nine ten eleven"), (None, None)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return corpus_pipeline.run(spark, str(tmp_path))


def test_odd_rows_and_clashing_columns(spark, tmp_path):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(30))
    rows = [(k, text(k), "en", None if k == 3 else "s", 100, -7.0, "own") for k in range(1, 6)]
    rows += [(6, None, None, None, None, None, None), (7, "", "en", "s", 0, 1.0, ""), (None, text(9), "en", "s", 5, 2.0, "x"), rows[0], (1, text(1), "de", "s", 100, 3.0, "other"), (8, text(1) + " more", "en", "s", 9, 0.0, "")]
    rows += [(9, "Seven: one two three four five six seven eight nine ten eleven", "en", "s", 9, 0.0, ""), (10, " ".join(["very long"] * 200_000), "en", "s", 9, 0.5, "")]
    out = run_on(spark, tmp_path, rows).collect()
    assert {r["doc_id"] for r in out} <= {1, 2, 3, 4, 5, 10, None} and len(out) == len({r["doc_id"] for r in out})
    assert {r["score"] for r in out if r["doc_id"] in (2, 4, 5)} <= {-7.0} and all(r["lang"] == "de" for r in out if r["doc_id"] == 1)


def test_no_documents(spark, tmp_path):
    assert run_on(spark, tmp_path, []).count() == 0
