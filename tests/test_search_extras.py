from __future__ import annotations

from coppice.operators import deadline, search
from coppice.plans import recall


def test_a_pattern_that_runs_away_is_stopped(spark):
    leaves = spark.createDataFrame([(1, "a" * 50_000 + "!"), (2, "plain foo.bar")], "leaf_id int, text string")
    rows, late = deadline.search(leaves, "(a+)+$", 200)
    assert late and rows.count() == 0
    rows, late = deadline.search(leaves, r"FOO\.bar", 5000)
    assert not late and [r.leaf_id for r in rows.collect()] == [2]
    assert deadline.search(leaves, r"FOO\.bar", 5000, case_sensitive=True)[0].count() == 0
    assert deadline.search(leaves, "foo.bar[", 5000)[0].count() == 0


def test_recall_of_the_published_workload(spark):
    got = recall.measure(spark)
    assert (got["elsewhere"], got["collisions"]) == (93, 94)
    assert (got["hinted"], got["global"], got["assisted"]) == (269, 266, 269)
    assert (got["unique"], got["colliding"]) == (206, 63)


def test_writers_keep_what_they_are_given(tmp_path):
    from coppice.plans.store import Tree

    for file, text in recall.documents([]).items():
        (tmp_path / file).write_text(text)
    tree = Tree(tmp_path)
    for i, (file, (_, branches)) in enumerate(list(recall.ROOTS.items()) * 2):
        text = f"**{i + 1:02d}.07.2026 — writer {i} — çğıöşü + **bold** | pipe · dash**"
        id_ = tree.append(file, branches[i % 4], text)["id"]
        leaf = tree.state().leaves[id_]
        assert (leaf["text"], leaf["file"], leaf["branch"]) == (text, file, branches[i % 4])


def test_search_folds_by_nfkc(spark):
    """Decomposed accents, full-width letters, a ligature and a no-break space, in leaves and in queries."""
    texts = ["un cafe\u0301 noir", "ＳＱＬＩＴＥ store", "the o\ufb03ce door", "red\u00a0apple pie"]
    leaves = spark.createDataFrame([(i, "f", "b", i, t) for i, t in enumerate(texts)], "leaf_id int, file string, branch string, line int, text string")
    queries = spark.createDataFrame(list(enumerate(["caf\u00e9 noir", "sqlıte store", "ｏｆｆｉｃｅ door", "red apple"])), "query_id int, query string")
    got = search.search(leaves, queries, mode="literal", threshold=2.0).collect()
    assert sorted((r.query_id, r.leaf_id) for r in got) == [(i, i) for i in range(4)]
    fuzzy = search.fuzzy(leaves, queries, 0.99).collect()
    assert sorted((r.query_id, r.leaf_id) for r in fuzzy) == [(i, i) for i in range(4)]


def test_regexes_are_those_of_the_jvm(spark):
    """What only Python compiles is literal, what only the JVM compiles is a regex; case folds beyond ASCII; nothing is lost by looking for literals first."""
    texts = ["year (?P<y>\\d{4}) here", "mot été 2024", "MOT ÉTÉ 2024", "foo1bar", "FOOxBAR", "KELVIN K", "a.b", None, "", "colour color"]
    leaves = spark.createDataFrame([(i, "f", "b", i, t) for i, t in enumerate(texts)], "leaf_id int, file string, branch string, line int, text string")
    asked = [r"(?P<y>\d{4})", r"\p{L}+ 2024", "ét. 2024", "foo.bar", "foo|color", "kelvin k.?", "(unclosed", r"colou?r", r"\Qa.b\E", "a.b", r"(?:foo)(.)bar", r"[fg]oo"]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id int, query string")
    got = {}
    for r in search.matches(leaves, queries, threshold=2.0).collect():
        got.setdefault(r.query_id, set()).add(r.leaf_id)
    assert got == {0: {0}, 1: {1, 2}, 2: {1, 2}, 3: {3, 4}, 4: {3, 4, 9}, 5: {5}, 7: {9}, 8: {6}, 9: {6}, 10: {3, 4}, 11: {3, 4}}
    sharp = search.matches(leaves, queries, mode="regex", threshold=2.0, case_sensitive=True).where("query_id in (2, 3)").collect()
    assert sorted((r.query_id, r.leaf_id) for r in sharp) == [(2, 1), (3, 3)]


def test_blocks_of_queries_and_tokens(spark, monkeypatch):
    texts = [f"needle{i} alpha beta{i % 7}" for i in range(40)]
    leaves = spark.createDataFrame([(i, f"f{i % 3}", "b", i, t) for i, t in enumerate(texts)], "leaf_id int, file string, branch string, line int, text string")
    queries = spark.createDataFrame([(i, f"needle{i} alphas", ["f1"] if i % 2 else None) for i in range(30)], "query_id int, query string, files array<string>")
    rows = lambda: sorted(map(tuple, search.search(leaves, queries, max_results=5).collect()))
    want = rows()
    monkeypatch.setattr(search, "QUERIES", 7)
    monkeypatch.setattr(search, "TOKENS", 5)
    assert rows() == want and len(want) > 100
    whole = search.matches(leaves, queries).groupBy("query_id").count().collect()
    assert {r.query_id: min(r["count"], 5) for r in whole} == {q: sum(w[0] == q for w in want) for q in {w[0] for w in want}}
