"""Importance resampling, collocations and suffix-array deduplication against plain versions of themselves."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from coppice.llm import collocations, common, resampling, suffixes
from coppice.operators import skew

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ["score", "rank", "words", "buckets", "_at", "part", "h", "id", "run", "anchor", "n", "times", "piece", "phrase", "a", "l", "r", "k", "found", "spans", "kept", "weight"]
AZ = {i: i + 32 for i in range(65, 91)}
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def table(spark, texts, ids=None, langs=None):
    ids, langs = ids or list(range(len(texts))), langs or ["en"] * len(texts)
    return spark.createDataFrame([(i, t, x, "s", len(t or "")) for i, t, x in zip(ids, texts, langs)], DOCS)


def clashing(df):
    return df.select("*", *(F.lit(7).alias(c) for c in CLASH if c not in df.columns))


def prose(rng, n, of=200):
    return " ".join(rng.choice(["W", "w", "É", "z"]) + str(int(of * rng.random() ** 2)) + rng.choice(["", "", ",", ".", "!\n"]) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    out = [prose(rng, rng.randint(1, 150)) for _ in range(150)]
    return out + out[:12] + [None, "", " \n\t ", "La " * 4000, prose(rng, 20_000), "one", "...", "a\x0bb\x0cc\rd e\x1cf ß漢字 Ⅷ"]


# --- 11 ---


def plain_resampling(docs, target, percent=5, least=20):
    def features(t):
        w = WORDS.findall((t or "").translate(AZ))
        return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]

    s, t = Counter(b for _, x in docs for b in features(x)[1]), Counter(b for x in target for b in features(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_t + 10000)))) for b in range(10000)]
    rows = []
    for i, x in docs:
        n, f = features(x)
        weight = sum(gain[b] for b in f)
        h = int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
        rows.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    may = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0]))
    rank = {r[0]: k + 1 for k, r in enumerate(may[: percent * len(may) // 100])}
    return {r[0]: (*r[1:], rank.get(r[0])) for r in rows}


@pytest.mark.parametrize("percent", [0, 5, 60, 100])
def test_resampling(spark, texts, percent):
    target = [texts[3], "W1 w2 w3 z4", None, texts[40]]
    got = resampling.resample(clashing(table(spark, texts)), table(spark, target), percent=percent)
    assert {r.doc_id: tuple(r)[1:] for r in got.collect()} == plain_resampling(list(enumerate(texts)), target, percent)


def test_resampling_of_little(spark):
    none = table(spark, [])
    assert resampling.resample(none, table(spark, ["a b"])).count() == 0
    same = " ".join(["word"] * 30)
    got = resampling.resample(table(spark, [same] * 40 + ["short"], [None, 7, 7] + list(range(100, 138))), none, percent=50).collect()
    assert {r.weight for r in got if r.n_words == 30} == {got[0].weight} and [r for r in got if r.doc_id is None][0].score is None
    ranked = sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, 20)) and all(a.score >= b.score for a, b in zip(ranked, ranked[1:]))
    with pytest.raises(ValueError):
        resampling.resample(none.withColumnRenamed("doc_id", "rank"), none, key="rank")


# --- 12 ---


def plain_collocations(rows, least, longest=5, best=2000):
    f, n = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(AZ)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    key = lang, tuple(w[i : i + k])
                    f[key] = f.get(key, 0) + 1
    many = {k: v for k, v in f.items() if v >= least and len(k[1]) > 1}
    dropped = {(lang, w[i:j]) for (lang, w), v in many.items() for i in range(len(w)) for j in range(i + 2, len(w) + 1) if j - i < len(w) and v >= many.get((lang, w[i:j]), math.inf)}
    out = {}
    for (lang, w), a in many.items():
        if (lang, w) not in dropped:
            cuts = [(1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return {(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, found in out.items() for i, (s, a, p, left, right) in enumerate(sorted(found)[:best])}


@pytest.mark.parametrize(("least", "held", "few"), [(5, 12 << 20, 1 << 14), (2, 200, 0)])
def test_collocations(spark, texts, monkeypatch, least, held, few):
    """With small lots and no label table broadcast, too."""
    monkeypatch.setattr(collocations, "HELD", held)
    monkeypatch.setattr(skew, "FEW_LABELS", few)
    rng = random.Random(3)
    langs = [rng.choice(["en", "de", "", None]) for _ in texts]
    docs = list(zip(texts, langs)) + [("x x x x x x x y; New York City! new york\tcity, new  york", "en")] * 9
    got = collocations.collocations(clashing(table(spark, [t for t, _ in docs], langs=[x for _, x in docs])), least=least)
    assert {tuple(r) for r in got.collect()} == plain_collocations(docs, least)
    top = collocations.collocations(table(spark, [t for t, _ in docs], langs=[x for _, x in docs]), least=least, best=3, longest=3)
    assert {tuple(r) for r in top.collect()} == plain_collocations(docs, least, 3, 3)


def test_collocations_of_nothing(spark):
    for texts in ([], [None, "", "...", "one two"]):
        assert collocations.collocations(table(spark, texts)).count() == 0


def test_full_maps_change_nothing(spark, monkeypatch):
    """A map in which each bit stands for many n-grams leaves less out; counts are the same."""
    monkeypatch.setattr(common, "SLICE", 3)
    monkeypatch.setattr(common, "MOST_BITS", 4)
    rng = random.Random(9)
    docs = [(prose(rng, 60, 12), "en") for _ in range(40)]
    got = collocations.collocations(table(spark, [t for t, _ in docs]), least=4)
    assert {tuple(r) for r in got.collect()} == plain_collocations(docs, 4)


def test_maps_have_what_was_put_in(spark):
    rng = np.random.default_rng(1)
    h = rng.integers(-(1 << 63), 1 << 63, 5000)
    bits, log = common.bit_map(spark.createDataFrame([(int(x),) for x in h], "h long"))
    spot = h.view(np.uint64) >> np.uint64(64 - log)
    assert np.all((bits[spot >> np.uint64(3)] >> (spot & np.uint64(7)).astype(np.uint8)) & 1) and np.unpackbits(bits).sum() == len(np.unique(spot))
    assert common.bit_map(spark.createDataFrame([], "h long")) is None


# --- 13 ---


@pytest.mark.parametrize("sparse", [0, 2, suffixes.SPARSE])
def test_suffix_arrays(sparse):
    rng = random.Random(sparse)
    for trial in range(150):
        t = [rng.randint(1, rng.choice([1, 2, 3, 20, 250])) for _ in range(rng.randint(0, 150))] * rng.choice([1, 1, 3]) + [0]
        want = sorted(range(len(t)), key=lambda i: t[i:])
        got = suffixes.suffix_array(np.array(t), sparse)
        assert got.tolist() == want
        shared = suffixes.common_prefixes(np.array(t, np.uint8), got)
        for x, y in zip(want, want[1:]):
            assert shared[y] == next(n for n in range(len(t)) if t[x + n] != t[y + n])


def plain_dedup(rows, length):
    """Rows of the same id and text are one document."""
    of = lambda i, h: (i is None, i or 0, h)
    seen, done = {}, {}
    for doc, raw in sorted({of(i, h): raw for i, h, raw in rows}.items()):
        covered = bytearray(len(raw))
        for at in range(len(raw) - length + 1):
            if seen.setdefault(raw[at : at + length], (doc, at)) != (doc, at):
                covered[at : at + length] = b"\1" * length
        spans = re.findall(rb"\x01+", bytes(covered))
        done[doc] = (len(raw), sum(covered), len(spans), hashlib.sha256(bytes(x for x, c in zip(raw, covered) if not c)).hexdigest())
    return [(i, *done[of(i, h)]) for i, h, _ in rows]


def dedup_rows(rng):
    passages = [prose(rng, rng.randint(15, 60)) for _ in range(12)] + ["boilerplate line of sixty bytes that stands nearly everywhere "]
    out = []
    for k in range(120):
        parts = [prose(rng, rng.randint(1, 40)) + (rng.choice(passages) if rng.random() < 0.4 else "") + (passages[-1] if k % 2 else "") for _ in range(rng.randint(1, 4))]
        out.append("".join(parts))
    near = out[3] + " tail"
    out += out[:10] + [near[:50] + "X" + near[51:], "a" * 700, "ab" * 300 + "c" + "ab" * 300, "é" * 333, (prose(rng, 30) + "\n") * 5, None, "", "short", "x" * 100, "x" * 101, "\x00" * 150, prose(rng, 6000)]
    return out


@pytest.mark.parametrize(("length", "hot", "shard", "held"), [(100, 2048, 4 << 20, 16 << 20), (64, 3, 4000, 3000), (33, 3, 1 << 20, 100)])
def test_suffix_dedup(spark, monkeypatch, length, hot, shard, held):
    """With small lots and shards and hot anchors, too; ids repeated, with other and with the same text, and null."""
    monkeypatch.setattr(suffixes, "HOT_RUNS", hot)
    monkeypatch.setattr(suffixes, "SHARD", shard)
    monkeypatch.setattr(suffixes, "HELD", held)
    rng = random.Random(length)
    texts = dedup_rows(rng)
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    docs = list(zip(ids, texts)) + [(ids[5], texts[5]), (ids[5], texts[6] + " more"), (None, texts[7]), (None, texts[7]), (None, texts[20] + texts[21])]
    frame = table(spark, [t for _, t in docs], [i for i, _ in docs]).repartition(5)
    hashes = {(r.doc_id, r.text): r.h for r in frame.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    got = suffixes.digest(suffixes.deduplicate(clashing(frame), length)).collect()
    want = plain_dedup([(i, hashes[i, t], (t or "").encode()) for i, t in docs], length)
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_suffix_dedup_of_nothing(spark):
    assert suffixes.deduplicate(table(spark, [])).count() == 0
    got = suffixes.digest(suffixes.deduplicate(table(spark, [None, "", "ab" * 20]))).orderBy("doc_id").collect()
    assert [(r.n_bytes, r.n_removed, r.n_spans) for r in got] == [(0, 0, 0), (0, 0, 0), (40, 0, 0)]
    with pytest.raises(ValueError):
        suffixes.deduplicate(table(spark, []), 20)


def test_spans_and_kept_bytes(spark):
    passage = prose(random.Random(2), 40)
    got = suffixes.deduplicate(table(spark, ["start " + passage, "ünd-" + passage + " end", passage])).orderBy("doc_id").collect()
    size = len(passage.encode())
    assert [[(s.start, s.stop) for s in r.spans] for r in got] == [[], [(5, 5 + size)], [(0, size)]]
    assert bytes(got[1].kept).decode() == "ünd- end" and bytes(got[2].kept) == b""
