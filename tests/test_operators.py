from __future__ import annotations

import itertools
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from coppice import api
from coppice.functions import text as T
from coppice.operators import audit, cluster, diff, index, references, replay, scan
from coppice.operators import search as S
from coppice.operators import similarity
from coppice.sources import trees


def tree(tmp_path, **files):
    for name, content in files.items():
        (tmp_path / f"root-{name.replace('_', '-')}.md").write_text(content)
    return str(tmp_path)


# --- a plain version of fuzzy scoring ---


def fold(s):
    return s.translate(str.maketrans("’`", "''")).translate(str.maketrans("Iİ", "ıi")).lower()


def stem(t):
    t = t.split("'")[0] if t.find("'") > 0 else t
    for e in T.ENDINGS:
        if t.endswith(e) and len(t) - len(e) >= 4:
            return t[: -len(e)]
    return t


def toks(s):
    return [t for t in map(stem, re.findall(r"[^\W_]+(?:'[^\W\d_]+)?", fold(s))) if len(t) > 1]


def grams(t):
    p = f"  {t} "
    return {p[i : i + 3] for i in range(len(p) - 2)}


def dice(a, b):
    return 1.0 if a == b else 2 * len(grams(a) & grams(b)) / (len(grams(a)) + len(grams(b)))


def score(q, t):
    q, t = toks(q), toks(t)
    best = [max((dice(a, b) for b in t), default=0) for a in q]
    return sum(best) / len(best) if q and t and min(best) >= 0.4 else 0.0


def test_text_functions(spark):
    one = spark.createDataFrame([("sqlite'ı", "Kararları İ")], "a string, b string")
    r = one.select(T.tokens(F.col("a")).alias("a"), T.tokens(F.col("b")).alias("b"), T.dice(F.lit("sqlite"), F.lit("sqltie")).alias("d"), T.slug(F.lit(" Été & Müller! ")).alias("s"), T.branch_key(F.lit(" A_b - C ")).alias("k")).first()
    assert (r.a, r.b, r.s, r.k) == (["sqlite"], ["karar"], "ete-muller", "a-b-c") and r.d == pytest.approx(3 / 7)
    assert spark.range(1).select(T.canonical_json(F.lit('{"b": [1, {"z": null, "a": 1.0}], "a": "ü"}'))).first()[0] == '{"a":"ü","b":[1,{"a":1,"z":null}]}'


def test_fuzzy_equals_the_plain_version(spark):
    rng = random.Random(3)
    words = ["sqlite", "sqltie", "kararlar", "karar", "gateway", "gatewya", "API", "ışık", "code-only-key", "o'clock", "x", "backup", "backups", "42", "grup7"]
    leaves = [(i, " ".join(rng.choices(words, k=rng.randint(0, 6)))) for i in range(60)]
    asked = [(i, " ".join(rng.choices(words, k=rng.randint(1, 3)))) for i in range(30)]
    got = {(r.query_id, r.leaf_id): r.score for r in S.fuzzy(spark.createDataFrame(leaves, "leaf_id int, text string"), spark.createDataFrame(asked, "query_id int, query string"), 0.42, False).collect()}
    want = {(q, i): s for (q, a), (i, t) in itertools.product(asked, leaves) if (s := score(a, t)) >= 0.42}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_search_on_a_tree(spark, tmp_path):
    folder = tree(tmp_path, **{"1_a": "# A\n\n## One\n\nsqlite kararlar defteri\n\ncode-only-key\n\nfoo.bar [x]\n", "2_b": "# B\n\n## Two\n\nexact needle here\n\nfooXbar\n", "3_c": "no branch needle\n"})
    run = lambda q, **k: api.search(spark, folder, q, **k).orderBy("rank").collect()
    assert [(r.match, r.text) for r in run("sqltie kararları")] == [("fuzzy", "sqlite kararlar defteri")]
    assert run("comment-only-key") == [] and run("") == [] and run("needle", max_results=0) == []
    assert [r.text for r in run("[", mode="regex")] == ["foo.bar [x]"]
    assert [r.text for r in run("foo.bar", mode="literal")] == ["foo.bar [x]"] and len(run("foo.bar")) == 2
    wrong = run("exact needle", files=["root-1-a.md"])
    assert wrong[0].route == "fallback" and wrong[0].match == "exact"
    hint = run("needle", files=["root-2-b.md"])
    assert {(r.file, r.route, r.match) for r in hint} == {("root-2-b.md", "hierarchy", "exact")}
    assert [r.branch for r in run("no branch needle")][0] == "(root)"
    with pytest.raises(ValueError):
        run("x", mode="other")
    with pytest.raises(ValueError):
        run("x" * 5000)
    assert api.lines(api.search(spark, folder, "exact needle")).first()[0] == "root-2-b.md › ## Two › exact needle here"


def test_similarity_join_equals_the_plain_join(spark):
    rng = random.Random(5)
    base = [rng.sample("abcdefghijklmnopqrstuvwxyz", rng.randint(1, 14)) for _ in range(25)]
    sets = [(i, sorted(set(b) ^ set(rng.sample("abcxyz", rng.randint(0, 1))))) for i, b in enumerate(base * 4)] + [(900, []), (901, []), (None, ["a"]), (902, None)]
    for least in (0.5, 0.85, 1.0):
        got = {(r.i, r.j): r.similarity for r in similarity.similar_pairs(spark.createDataFrame(sets, "id int, t array<string>"), "id", "t", least).collect()}
        own = [(i, set(s)) for i, s in sets if i is not None and s]
        want = {(i, j): len(a & b) / len(a | b) for (i, a), (j, b) in itertools.combinations(own, 2) if len(a & b) / len(a | b) >= least}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_similar_sets_of_a_hot_token_in_cells(spark, monkeypatch):
    """All sets share a rare-looking token and are near each other; chunks of three make many cells."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(30)]
    sets = [(i, ["hot", *(w if rng.random() < 0.97 else f"x{i}{w}" for w in base)]) for i in range(60)] + [(100 + i, rng.sample(base, 25)) for i in range(20)]
    want = {(i, j): len({*a} & {*b}) / len({*a} | {*b}) for (i, a), (j, b) in itertools.combinations(sets, 2)}
    for chunk, at_once in ((3, 7), (2048, 1 << 18)):
        monkeypatch.setattr(similarity, "CHUNK", chunk)
        monkeypatch.setattr(similarity, "AT_ONCE", at_once)
        for least in (0.5, 0.85):
            got = {(r.i, r.j): r.similarity for r in similarity.similar_pairs(spark.createDataFrame(sets, "id int, t array<string>"), "id", "t", least).collect()}
            assert got == {k: pytest.approx(v) for k, v in want.items() if v >= least}


def test_sets_that_are_unlike_are_not_paired_by_the_words_of_many(spark):
    """Sets of common words, each with most of them by chance: unlike ones don't become candidates, however many meet in a word."""
    rng = random.Random(3)
    base = [rng.sample(range(600), 200) for _ in range(400)]
    sets = [(i, [*b[:-2], 1000 + i]) for i, b in enumerate(base + base[:20])]
    rows = spark.createDataFrame(sets, "id long, hashes array<long>")
    found = {(r.a, r.b) for r in similarity.candidates(similarity.parts(rows, 0.85), 0.85).collect()}
    assert {(i, 400 + i) for i in range(20)} <= found and len(found) < 100


def test_similar_sets_that_meet_in_parts_of_few_and_of_many(spark, monkeypatch):
    """Groups of near copies about the limit, too large for pairs by single parts; cells small and large."""
    rng = random.Random(11)
    sets = []
    for g, many in enumerate((25, 6, 3, 12)):
        base = [f"g{g}w{i}" for i in range(rng.randint(90, 160))]
        sets += [(len(sets) + i, [w if rng.random() < 0.95 else f"x{g}.{i}{w}" for w in base]) for i in range(many)]
    sets += [(1000 + i, s) for i, s in sets[::5]] + [(2000 + i, rng.sample(sets[0][1] + sets[30][1], 80)) for i in range(10)]
    want = {(i, j): len({*a} & {*b}) / len({*a} | {*b}) for (i, a), (j, b) in itertools.combinations(sets, 2)}
    want = {k: v for k, v in want.items() if v >= 0.85}
    rows = spark.createDataFrame(sets, "id int, t array<string>")
    for many, chunk, small in ((2, 4, 1 << 10), (4, 2048, 0)):
        monkeypatch.setattr(similarity, "MANY", many)
        monkeypatch.setattr(similarity, "CHUNK", chunk)
        monkeypatch.setattr(similarity, "SMALL", small)
        got = similarity.similar_pairs(rows, "id", "t", 0.85).collect()
        assert len(got) == len(want) and {(r.i, r.j): r.similarity for r in got} == {k: pytest.approx(v) for k, v in want.items()}
        assert {r.id: r.links for r in similarity.links(rows, "id", "t", 0.85).collect()} == {i: sum(i in k for k in want) for i, _ in sets}


def test_a_group_of_near_copies_is_sent_by_sets_and_not_by_pairs(spark):
    """150 sets that are all similar: 11,175 pairs in dozens of parts each, but few rows go to where they are compared."""
    sets = [(i, [*range(200), 1000 + 2 * i, 1001 + 2 * i]) for i in range(150)]
    rows = spark.createDataFrame(sets, "id long, hashes array<long>").withColumn("label", F.lit(None).cast("string"))
    pairs, cells = similarity._found(similarity.parts(rows, 0.85), 0.85)
    assert pairs.count() < 50 and cells.count() <= 2 * len(sets)
    sent = similarity._compared(pairs, cells, rows)
    assert sent.count() <= 3 * len(sets) and similarity._pairs(sent, 0.85).count() == 150 * 149 // 2


def test_the_words_of_a_text_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("array<string>")
    def words(text):
        made.add(1)
        return text.split()

    rows = spark.range(20).select("id", F.lit("a b c").alias("text")).withColumn("t", words("text"))
    assert similarity.links(rows, "id", "t").where("links = 19 and class = 0").count() == 20 and made.value == 20


def test_audits(spark, tmp_path):
    many = "\n\n".join(f"leaf {i} of words{i} other{i}" for i in range(50))
    folder = tree(tmp_path, **{
        "0_index": "# I\n\n## M\n\n" + "\n\n".join(f"entry{i} item{i}" for i in range(15)) + "\n",
        "1_a": "# A\n" + "".join(f"\n## B{i}\n\ntext{i}\n" for i in range(9)),
        "2_b": f"# B\n\n## Big\n\n{many}\n\n## Dup\n\nshared phrase repeated verbatim\n",
        "3_c": "# C\n\n## Dup\n\nshared phrase repeated verbatim\n\nshared phrase repeated verbatim bkz: root-2 / Dup\n\nbkz: root-8-gone.md\n",
    })
    found = api.findings(spark, folder).collect()
    count = lambda code: sum(f.code == code for f in found)
    assert (count("index-bloat"), count("root-branches"), count("branch-leaves"), count("duplication"), count("broken-ref")) == (1, 1, 1, 1, 1)
    assert [f.level for f in found if f.code == "branch-leaves"] == ["error"]
    assert audit.by_level(spark.createDataFrame(found)).first().asDict() == {"errors": 2, "warnings": 3}


def test_chains_and_statuses(spark):
    edges = spark.createDataFrame([("a", "b", "resolved"), ("b", "c", "resolved"), ("c", "c", "resolved"), ("x", None, "legacy-unresolved"), ("c", "gone", "resolved")], "source string, target string, status string")
    live = spark.createDataFrame([("a",), ("b",), ("c",), ("x",)], "id string")
    assert {tuple(r) for r in references.chains(edges, live).select("source", "middle", "target").collect()} == {("a", "b", "c"), ("b", "c", "c"), ("c", "c", "c")}
    assert references.broken(edges, live).count() == 2


def test_references_by_metadata(spark):
    leaves = [("s", "root-1-a.md", "One", "bkz: root-2 / Two (x); bkz: root-2 / Many"), ("t", "root-2-b.md", "Two", "here"), ("m1", "root-2-b.md", "Many", "1"), ("m2", "root-2-b.md", "Many", "2")]
    leaves = spark.createDataFrame(leaves, "leaf_id string, file string, branch string, text string")
    plain = {r.human: (r.target, r.status) for r in references.resolve(leaves).collect()}
    assert plain == {"bkz: root-2 / Two": ("t", "resolved"), "bkz: root-2 / Many": (None, "legacy-unresolved")}
    explicit = spark.createDataFrame([("s", 0, None, "m2"), ("s", 1, 1, "m1"), ("s", 2, 7, "lost")], "leaf_id string, ord int, place int, target string")
    named = {(r.human, r.target): r.status for r in references.resolve(leaves, explicit).collect()}
    assert named == {("bkz: root-2 / Two", "m2"): "resolved-path-mismatch", ("bkz: root-2 / Many", "m1"): "resolved", ("bkz:", "lost"): "unresolved"}


def test_replay_equals_a_plain_fold(spark):
    rng = random.Random(11)
    ops = [(rng.choice("abcd"), i, rng.choice(["upsert", "upsert", "provenance", "delete", "forget"] if i % 9 == 0 else ["upsert", "provenance", "provenance", "delete"]), float(i), {"confidence": rng.choice([None, str(i)])} if rng.random() < 0.8 else {"source": "s"}) for i in range(90)]
    live, changes, forgotten = {}, {}, set()
    for id_, i, kind, value, prov in ops:
        if kind == "upsert" and id_ in forgotten or kind == "provenance" and id_ not in live:
            continue
        if kind == "upsert":
            live[id_] = {"value": value, "seq": i, "confidence": None, "source": None}
        elif kind == "provenance":
            live[id_] |= {"seq": i, **prov}
        else:
            live.pop(id_, None)
            forgotten |= {id_} if kind == "forget" else set()
        changes[id_] = i
    df = spark.createDataFrame(ops, "id string, seq long, type string, value double, provenance map<string,string>")
    got = {r.id: {k: r[k] for k in ("value", "seq", "confidence", "source")} for r in replay.leaf_state(df, fields=("confidence", "source")).collect()}
    assert got == live
    assert {r.id: r.seq for r in replay.last_changes(df).collect()} == changes
    assert {r.id for r in replay.tombstones(df).collect()} == forgotten


def test_summaries_merge_in_any_grouping(spark):
    """The state from summaries of random parts of a log is that of the whole log."""
    rng = random.Random(5)
    kinds = ["upsert"] * 4 + ["provenance"] * 5 + ["delete"] * 2 + ["forget"]
    ops = [(f"i{rng.randrange(40)}", i, rng.choice(kinds), f"v{i}", {rng.choice(["confidence", "source"]): rng.choice([None, str(i)])}) for i in range(600)]
    df = spark.createDataFrame(ops, "id string, seq long, type string, value string, provenance map<string,string>")
    fields = ("confidence", "source")
    want = sorted(map(tuple, replay.states(replay.summaries(df, fields=fields), fields).collect()))
    rng.shuffle(ops)
    parts = [spark.createDataFrame(ops[a:b], df.schema) for a, b in ((0, 1), (1, 250), (250, 600))]
    summed = [replay.summaries(p, fields=fields) for p in parts]
    for one, two, three in itertools.permutations(summed):
        again = replay.merge(replay.merge(one.unionByName(two), fields).unionByName(three), fields)
        assert sorted(map(tuple, replay.states(again, fields).collect())) == want
    plan = replay.leaf_state(df, fields=fields)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "partial_max_by" in plan


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_prefix_scan(spark, monkeypatch, parts):
    """One long group, small ones, nulls in keys and values, over few and many ranges."""
    rng = random.Random(parts)
    rows = [("long", i, f"h{i}" if i % 7 else None) for i in range(400)] + [(rng.choice(["a", "b", None, "m", "z"]), 1000 + i, str(i)) for i in range(60)] + [("one", 5, "x")]
    want, last = {}, {}
    for g, o, v in sorted(rows, key=lambda r: r[1]):
        n, before = last.get(g, (0, None))
        want[g, o] = (n + 1, before)
        last[g] = (n + 1, v)
    rng.shuffle(rows)
    kept = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, "g string, o long, v string")
        got = scan.numbered(df, ["g"], ["o"], "p", {"before": "v"}).collect()
        assert len(got) == len(rows) and {(r.g, r.o): (r.p, r.before) for r in got} == want
        assert scan.numbered(df.limit(0), ["g"], ["o"]).count() == 0
        log = spark.createDataFrame([("long", i, i if i < 333 else i + 1) for i in range(1, 500)] + [("good", i, i) for i in range(1, 90)], "s string, line long, seq long")
        assert {tuple(r) for r in replay.first_bad(log, "s", "line", "seq").collect()} == {("long", 333), ("good", None)}
        assert {tuple(r) for r in replay.valid_prefix(log, "s", "line", "seq").groupBy("s").count().collect()} == {("long", 332), ("good", 89)}
        plan = replay.valid_prefix(log, "s", "line", "seq")._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", kept[1])


@pytest.mark.parametrize("parts", [1, 2, 13])
def test_fills_and_as_of_joins_by_ranges(spark, parts):
    """One group holds most rows; the last value goes on over ranges without one; ties and groups without points."""
    rng = random.Random(parts)
    rows = [("big" if rng.random() < 0.8 else rng.choice(["a", "b", None]), i, i * 10 if rng.random() < 0.05 else None) for i in range(500)]
    last, want = {}, {}
    for g, i, v in sorted(rows, key=lambda r: -r[1]):
        last[g] = v if v is not None else last.get(g)
        want[i] = last[g]
    rng.shuffle(rows)
    points = [("big", rng.randrange(300), i) for i in range(40)] + [("a", 5, 1), ("a", 5, 0)]
    marks = [(rng.choice(["big", "big", "a", "none"]), rng.randrange(320), 1000 + i) for i in range(200)]
    kept = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = scan.numbered(spark.createDataFrame(rows, "g string, i long, v long"), ["g"], [F.desc("i")], "p", filled={"w": "v"})
        assert {r.i: r.w for r in got.collect()} == want
        met = diff.forward(spark.createDataFrame(points, "g string, t long, x long"), spark.createDataFrame(marks, "g string, t long, x long"), "g", "t", "x")
        after = lambda g, t: min(((pt, px) for pg, pt, px in points if pg == g and pt >= t), default=(None, None))
        assert {(r.mark, r.next_at, r.next_value) for r in met.collect()} == {(x, *after(g, t)) for g, t, x in marks}
        assert "Window" not in met._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", kept[1])


def test_chains_through_hubs(spark, monkeypatch):
    """A hub in many cells gives the same chains; `most` leaves it out, and `middles` counts it."""
    monkeypatch.setattr(references, "CELL", 4)
    rng = random.Random(3)
    edges = {("s%d" % i, "hub") for i in range(30)} | {("hub", "t%d" % i) for i in range(25)} | {(rng.choice("abcdef"), rng.choice("abcdef")) for _ in range(20)}
    frame = spark.createDataFrame([(*e, "resolved") for e in edges] * 2, "source string, target string, status string")
    live = spark.createDataFrame([(x,) for x in {x for e in edges for x in e} - {"f"}], "id string")
    good = {e for e in edges if "f" not in e}
    want = {(a, b, d) for a, b in good for c, d in good if b == c}
    got = [tuple(r) for r in references.chains(frame, live).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert {tuple(r) for r in references.chains(frame, live, 100).collect()} == {w for w in want if w[1] != "hub"}
    counted = {r.middle: (r.sources, r.targets, r.chains) for r in references.middles(frame, live).collect()}
    assert counted["hub"] == (30, 25, 750) and sum(c for _, _, c in counted.values()) == len(want)


def test_keys_looked_up_with_hot_ones_apart(spark, monkeypatch):
    from coppice.operators import skew

    rows = [("hot", i) for i in range(50)] + [("gone", i) for i in range(40)] + [(f"k{i}", i) for i in range(30)] + [(None, 1)]
    ids = spark.createDataFrame([("hot",), ("hot",), ("k3",), (None,), ("other",)], "id string")
    for hot in (1, 4, 1 << 12):
        monkeypatch.setattr(skew, "HOT", hot)
        got = skew.flagged(spark.createDataFrame(rows, "k string, v int"), "k", ids, "id", "there").collect()
        assert sorted((r.k or "", r.v, r.there) for r in got) == sorted((k or "", v, k in ("hot", "k3")) for k, v in rows)


def test_roots_by_the_beginnings_of_their_names(spark):
    leaves = spark.createDataFrame([("f", "b", 1, "bkz: root-1-top and ROOT-2.md; root-33"), ("f", "b", 2, "root-9 without the word"), ("f", "b", 3, None)], "file string, branch string, line int, text string")
    roots = spark.createDataFrame([("Root-1-Topics.md",), ("root-3-x.md",)], "file string")
    found = references.missing_roots(leaves, roots)
    assert sorted((r.line, r.reference) for r in found.collect()) == [(1, "ROOT-2.md"), (1, "root-33")]
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("size", [3, 512])
def test_a_kept_index(spark, tmp_path, monkeypatch, size):
    """Small blocks, a word in nearly every leaf, ids far apart; changes, a new and a lost token, then searches from files."""
    monkeypatch.setattr(index, "BLOCK", size)
    rng = random.Random(size)
    words = [f"w{i}" for i in range(15)]
    draw = lambda: ["all", *rng.sample(words, rng.randint(0, 6))] * rng.choice([1, 1, 2])
    state = {rng.choice([i, i * 1_000_003, -i]): draw() for i in range(200)}
    frame = lambda rows: spark.createDataFrame([(k, v) for k, v in rows.items()], "leaf_id long, tokens array<string>")
    now = index.build(frame(state))
    want = lambda of: {(t, k) for k, v in of.items() for t in v}
    assert sorted(map(tuple, index.postings(now).collect())) == sorted(want(state))
    for turn in range(3):
        old = {k: state[k] for k in rng.sample(sorted(state), 30)}
        put = {k: draw() for k in list(old)[:20]} | {300_000_000 + 10_000 * turn + i: [*draw(), f"new{turn}"] for i in range(25)} | {-999_999 - turn: ["all", "w1"]}
        now = index.update(now, frame(old), frame(put))
        state = {k: v for k, v in state.items() if k not in old} | put
    got = now.collect()
    assert sorted(map(tuple, index.postings(now).collect())) == sorted(want(state)) and max(b.n for b in got) <= size
    by_token = {}
    for b in sorted(got, key=lambda b: (b.token, b.first)):
        assert b.first > by_token.get(b.token, -(1 << 62)) and b.last >= b.first
        by_token[b.token] = b.last
    index.save(now, str(tmp_path / "index"))
    asked = [(0, ["all"]), (1, ["w1", "w2", "all"]), (2, ["new2", "w3"]), (3, ["absent", "all"]), (4, []), (5, ["w1", "w1"]), (6, ["w1", "w2", "w3", "w4"])]
    found = index.search(spark.read.parquet(str(tmp_path / "index")), spark.createDataFrame(asked, "query_id int, tokens array<string>")).collect()
    assert sorted(map(tuple, found)) == sorted((q, k) for q, t in asked for k, v in state.items() if t and set(t) <= set(v))


def test_similar_tokens_by_their_rarer_grams(monkeypatch):
    """Equal to counting all grams, also where most grams of a word are frequent, and for large indexes; each word costs far less than its frequent grams' postings."""
    rng = random.Random(7)
    some = lambda n: ["".join(rng.choices("aabeinrstüж", k=rng.randint(2, 9))) for _ in range(n)]
    own, words = sorted({*some(150), "aaaaaa", "ab"}), sorted({*some(400), "aaaa", "ab", "x"})
    want = {(i, k): dice(w, t) for i, w in enumerate(words) for k, t in enumerate(own) if 2 * len(grams(w) & grams(t)) / (len(grams(w)) + len(grams(t))) >= 0.4}
    for spare in (4, 0):
        monkeypatch.setattr(S, "SPARE", spare)
        got = {(int(a), int(b)): float(c) for i, k, v in S.GramIndex(own).similar(words, 0.4) for a, b, c in zip(i, k, v)}
        assert got == want
    assert S.GramIndex([]).sizes.size == 0 and not list(S.GramIndex([]).similar(words, 0.4))


def test_texts_are_taken_in_slices(spark):
    """A task makes a few texts at a time Python's; what NFKC leaves alone isn't sent to Python for it, and the rest is normalised as before."""
    import unicodedata

    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([*([pa.array(range(40))] * 3), pa.array(["x" * 300_000] * 40), pa.array([None] * 40, pa.string())], list("abcde"))
    sizes = [b.num_rows for b in S.parts(iter([batch]))]
    assert sum(sizes) == 40 and max(sizes) <= 6
    inert = [chr(c) for c in range(0x500) if re.match("[" + "".join(f"\\U{int(a, 16):08x}-\\U{int(b, 16):08x}" for a, b in re.findall(r"x\{(\w+)\}-\\x\{(\w+)\}", T.INERT)) + "]", chr(c))]
    assert {"ü", "ı", "ж"} <= set(inert) and not {"ﬁ", "\u0301", "²", "ĳ"} & set(inert)
    assert all(unicodedata.is_normalized("NFKC", a + b) for a in inert for b in inert)
    texts = ["plain", "für ığdır ж", "ﬁne", "e\u0301", "ü²", "", None, "ſ ünd ½"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in frame.select(T.compatible(F.col("t"))).collect()] == [t if t is None else unicodedata.normalize("NFKC", t) for t in texts]


def test_an_index_is_merged_from_lists(spark, monkeypatch):
    """Tasks gather ids into lists before they are shuffled; a token in every leaf is merged range by range, and its blocks never overlap."""
    for name, value in (("BLOCK", 4), ("SPAN", 32), ("GATHER", 300), ("MERGED", 40), ("FEW", 0)):
        monkeypatch.setattr(index, name, value)
    frame = lambda ids, *more: spark.createDataFrame([(i, ["all", f"w{i % 3}", *more, None]) for i in ids], "leaf_id long, tokens array<string>")
    own = frame(range(0, 600, 3))
    marks = index.marks_of(own)
    assert len(marks) == 6 and index.lists(own.withColumn("op", F.lit(1)), []).count() <= 2 * 8
    now = index.build(own)
    for _ in range(2):
        now = index.update(now, frame(range(0, 600, 6)), frame([*range(1, 600, 3), -(1 << 62), 1 << 62], "late"))
    there = [*range(3, 600, 6), *range(1, 600, 3), -(1 << 62), 1 << 62]
    want = {("all", i) for i in there} | {(f"w{i % 3}", i) for i in there} | {("late", i) for i in there if i % 3 == 1 or abs(i) == 1 << 62}
    assert sorted(map(tuple, index.postings(now).collect())) == sorted(want)
    found = sorted(now.where("token = 'all'").collect(), key=lambda b: b.first)
    assert all(a.last < b.first for a, b in zip(found, found[1:])) and max(b.n for b in found) <= 4
    ids = [0, 1, 1 << 20, 1 << 40, (1 << 63) - 1, -(1 << 63), 5]
    start = index.np.array([0, 2, 5], int)
    data = index.packed(index.np.array(ids), start)
    assert index.unpacked(index.np.array(ids)[start], data)[0].tolist() == ids


def test_commits_must_name_their_operations(spark):
    ops = spark.createDataFrame([("t", 1, "x"), ("t", 2, "y"), ("u", 4, "z"), ("v", 6, "w")], "tx string, seq long, hash string")
    commits = spark.createDataFrame([("t", 3, ["x", "y"]), ("u", 5, ["q"])], "tx string, seq long, hashes array<string>")
    assert {(r.tx, r.seq, r.commit_seq) for r in replay.committed(ops, commits).collect()} == {("t", 1, 3), ("t", 2, 3)}


def test_reconcile_and_selectors(spark):
    base = spark.createDataFrame([("a", "h", 5), ("b", "h", 5), ("c", "h", 5)], "id string, contentHash string, checkpoint long")
    now = spark.createDataFrame([("a", "h2"), ("b", "h"), ("d", "h")], "id string, contentHash string")
    changes = spark.createDataFrame([("a", 9), ("b", 9)], "id string, changed long")
    assert {tuple(r) for r in diff.reconcile(base, now, changes, fields=("contentHash",)).collect()} == {("a", "changed", True), ("c", "deleted", False), ("d", "added", False)}
    leaves = spark.createDataFrame([("1", "alpha"), ("2", "alpha beta")], "leaf_id string, text string")
    hits = {r.selector: (r.hits, r.leaf_id) for r in diff.selectors(leaves, spark.createDataFrame([("1",), ("alpha",), ("beta",), ("no",)], "selector string")).collect()}
    assert hits == {"1": (1, "1"), "alpha": (2, None), "beta": (1, "2"), "no": (0, None)}


def test_cluster_golden(spark):
    texts = ["apple orchard alpha", "apple orchard bravo", "apple orchard charlie", "engine motor delta", "engine motor echo", "engine motor foxtrot"]
    leaves = spark.createDataFrame([(f"l{i}", "f", "B", i, t) for i, t in enumerate(texts)], "leaf_id string, file string, branch string, index int, text string")
    rows = cluster.split_branches(leaves).orderBy("keyword").collect()
    assert [(r.cluster, r.leaf_ids, r.confidence) for r in rows] == [("B / Apple", ["l0", "l1", "l2"], 0.8), ("B / Engine", ["l3", "l4", "l5"], 0.8)]
    assert [(e.keyword, e["count"]) for e in rows[0].evidence] == [("apple", 3), ("orchard", 3), ("alpha", 1)] and rows[0].overall == 0.8
    assert cluster.propose([]) is None and cluster.propose([cluster.Leaf("a", 0, frozenset("ab"))]) is None
    assert cluster.three(0.7083) == 0.708


def test_index_blocks_of_ranges_in_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(index, "SPAN", 100)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        own = spark.createDataFrame([(i, ["all", f"of{i % 3}"]) for i in range(1500)], "leaf_id long, tokens array<string>")
        now = index.build(own)
        blocks = sorted((b.token, b.first, b.last) for b in now.collect())
        assert all(a[0] != b[0] or a[2] < b[1] for a, b in zip(blocks, blocks[1:]))
        found = index.search(now, spark.createDataFrame([(1, ["all", "of1"]), (2, ["all"])], "query_id int, tokens array<string>")).collect()
        assert sorted(map(tuple, found)) == [(1, i) for i in range(1, 1500, 3)] + [(2, i) for i in range(1500)]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_words_of_audits_and_emphasis(spark):
    said = [("__01.02.2024__ **The** word__ `word` or|bir x-y", ["word", "x-y"]), ("_01.02.2024 __a1b__ a1b", ["2024", "a1b"]), (None, None), ("", [])]
    rows = spark.createDataFrame([(t,) for t, _ in said], "t string").select(T.audit_tokens(F.col("t")).alias("w")).collect()
    assert [r.w for r in rows] == [w for _, w in said]


def test_links_between_documents(spark, tmp_path):
    deep = tmp_path / "one" / "two" / "three" / "four" / "five" / "six"
    deep.mkdir(parents=True)
    (tmp_path / "sub").mkdir()
    (tmp_path / "scripts").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "scripts" / "tool.sh").write_text("")
    (tmp_path / "sub" / "a picture.png").write_bytes(b"x")
    (tmp_path / "a.md").write_text('[ok](sub/b.md) [lost](c.md) [web](https://x/y.md) [m](mailto:a@b.md) [here](#part) [t](sub/b.md "title") [t](sub/no.png "title") ![p](sub/a%20picture.png) [folder](sub) [any](x/*.md) [h](.hidden.md) [h](.none.md)')
    (tmp_path / "sub" / "b.md").write_text("[up](../a.md#part) [lost](../sub/d.md) [root](/a.md) [root](/b.md) `scripts/tool.sh` `scripts/none.sh` [tool](scripts/tool.sh) `other/none.sh`")
    (deep / "c.md").write_text("[six up](../../../../../../a.md) [seven](../../../../../../z/../a.md) [lost](../../../../../../z.md)")
    (tmp_path / ".hidden.md").write_text("")
    (tmp_path / "node_modules" / "n.md").write_text("[lost](gone.md)")
    (tmp_path / "LOG.md").write_text("[lost](gone.md)")
    got = {(r.path.rsplit("/", 1)[1], r.link) for r in trees.check(spark, str(tmp_path), ("LOG.md",)).collect()}
    assert got == {("a.md", "c.md"), ("a.md", "sub/no.png"), ("a.md", ".none.md"), ("b.md", "../sub/d.md"), ("b.md", "/b.md"), ("b.md", "scripts/none.sh"), ("c.md", "../../../../../../z.md")}


def test_links_ask_the_store_last(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([("/gone/a/b.md", "[up](../../gone/./a/c.md), [self](./../a/b.md), [far](../../../..//gone/a), [dots](x/../../n.md)")], "path string, content string")
    lost = trees.broken_links(docs, docs.select("path"), "/gone")
    # once, for what no file accounts for: neither for all links nor for the files
    assert lost._jdf.queryExecution().executedPlan().toString().count("_there(") == 1
    assert {r.link for r in lost.collect()} == {"../../gone/./a/c.md", "x/../../n.md"}

    asked = []
    class Store:
        def get_file_info(self, names):
            asked.append(names)
            return trees.pafs.LocalFileSystem().get_file_info(names)

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "_empty").touch()
    monkeypatch.setattr(trees, "_store", lambda base: Store())
    trees._missing.cache_clear()
    here = str(tmp_path).lstrip("/")
    found = trees._found([f"{here}/none/{i}/{j}" for i in range(50) for j in range(9)] + [f"file:/{here}/in/{x}" for x in ("_empty", "b", "_empty/c")] + ["", "nowhere:/x/y"])
    trees._missing.cache_clear()
    assert [i for i, x in enumerate(found) if x] == [450, 453]
    # a folder that isn't there is asked for once, for all below it
    assert sum("none" in str(x) for x in asked) == 1 and len(asked) < 30


def test_needles_in_blocks(spark, monkeypatch):
    from coppice.operators import needles

    texts = spark.createDataFrame([(1, "abc bcd"), (2, "bc"), (3, None), (4, ""), (5, "xyz")], "id int, t string")
    asked = spark.createDataFrame([("bc",), ("bc",), ("abc",), ("",), (None,), ("zz",)], "n string")
    want = {("bc", 1), ("bc", 2), ("abc", 1)}
    assert {tuple(r) for r in needles.containing(texts, "id", "t", asked).collect()} == want
    monkeypatch.setattr(needles, "NEEDLES", 1)
    assert {tuple(r) for r in needles.containing(texts, "id", "t", asked).collect()} == want
    assert needles.containing(texts, "id", "t", asked.limit(0)).count() == 0


def test_cli(tmp_path, capsys):
    from coppice.__main__ import main

    folder = tree(tmp_path, **{"1_a": "# A\n\n## One\n\n_No entries yet._\n"})
    assert main(["import", folder]) == 0 and main(["append", folder, "root-1-a.md", "One", "a leaf"]) == 0
    capsys.readouterr()
    assert main(["search", folder, "leaf"]) == 0
    assert json.loads(capsys.readouterr().out)[0]["text"] == "a leaf"
    assert main(["search", folder, "absent"]) == 1 and main(["lint", folder, "--fail-on-warn"]) == 0
