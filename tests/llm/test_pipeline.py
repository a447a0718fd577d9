from __future__ import annotations

import re

import corpus_pipeline as P
import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in P.STAGES:
        out[name] = (docs, stage(spark, docs, SF))
        path = str(tmp_path_factory.mktemp("stage") / name)
        out[name][1].write.parquet(path)
        docs = spark.read.parquet(path)
        out[name] = (out[name][0], docs)
    return out


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_stages_return_documents(spark, stages):
    for name, (before, after) in stages.items():
        assert name == "packing" or after.schema.names == before.schema.names == P.COLUMNS
        assert ids(after) <= ids(before)
    assert P.run(spark, SF).count() == stages["packing"][1].count() > 0


def test_quality_keeps_clean_documents(spark, stages):
    before, after = stages["quality"]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = ids(after)
    good = [i for i in ids(before) if labels.get(i) == 1]
    assert sum(i in kept for i in good) >= 0.97 * len(good)


def bag(t):
    w = t.encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_near_copies_leave_one(stages):
    before, after = stages["near_copies"]
    rows = {r.doc_id: bag(r.text) for r in before.collect()}
    group = {i: i for i in rows}
    for i in sorted(rows):
        for j in sorted(rows):
            if i < j and len(rows[i] & rows[j]) >= 0.8 * len(rows[i] | rows[j]):
                a, b = sorted((group[i], group[j]))
                group = {k: a if v == b else v for k, v in group.items()}
    assert ids(after) == set(group.values())


def test_leaks_go(spark, stages):
    before, after = stages["decontamination"]
    flat = lambda t: " ".join(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t.lower()))
    items = [flat(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaked = {r.doc_id for r in before.collect() if any(f" {i} " in f" {flat(r.text)} " for i in items)}
    assert ids(before) - ids(after) == leaked


def test_secrets_are_masked_and_nothing_else(stages):
    before, after = ({r.doc_id: r for r in x.collect()} for x in stages["secrets"])
    assert before.keys() == after.keys()
    for i, r in after.items():
        assert r.n_chars == len(r.text) and not re.search(r"AKIA[A-Z0-9]{12}|[0-9a-f]{32}", r.text)
        assert r.text == before[i].text or "[secret]" in r.text


def test_all_documents_are_packed(stages):
    before, after = stages["packing"]
    assert ids(after) == ids(before)
