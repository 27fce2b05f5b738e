"""What depends on no size: joins of op11's vocabulary are never broadcast; op6 looks into all pairs of subtrees."""

from pagewarden.llm import htmltext, spelling


def test_vocabulary_is_never_broadcast(spark):
    words = spark.createDataFrame([("lettering", 100), ("letterng", 5), ("leterng", 1)], "word string, n long").localCheckpoint()
    found = spelling.forms(words)
    for df in (spelling.near_words(words), found, spelling.roots(found)):
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()
        df.collect()
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()
    assert {r["word"]: r["root"] for r in spelling.roots(found).collect()} == dict.fromkeys(("lettering", "letterng", "leterng"), "lettering")


def test_all_pairs_of_subtrees_are_matched(monkeypatch):
    monkeypatch.setattr(htmltext, "PAIRS", 1, raising=False)
    numbers: dict = {}
    a = htmltext.Shape("r(d(a b c) d(e f))", numbers)
    b = htmltext.Shape("r(d(z) d(a b) d(e f g))", numbers)
    got = {(a.labels[i], b.labels[j]) for i, j in htmltext.Matching(a, b).pairs()}
    assert got == {(x, x) for x in "rdabef"}
