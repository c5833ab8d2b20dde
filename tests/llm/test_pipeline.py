"""The corpus pipeline: each stage against its operator's brute-force rule, and the whole."""

from __future__ import annotations

import pytest

import corpus_pipeline
from migcheck.llm import sanitise, toxicity
from migcheck.llm.shared import materialise, table
from tests.llm.test_decontaminate import brute as brute_hits
from tests.llm.test_jaccard_join import brute as brute_links
from tests.llm.test_sanitise import brute as brute_spans
from tests.llm.test_tokens import direct


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    out = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = out[name] = materialise(stage(spark, docs, sf_dir), name)
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages_keep_the_columns(stages):
    names = list(stages)
    for name in names[:-1]:
        assert stages[name].columns == stages["documents"].columns
    assert "sequence_id" in stages[names[-1]].columns


def test_near_duplicates(stages):
    before = [(i, r.text) for i, r in rows(stages["toxicity"]).items()]
    assert sorted(rows(stages["near_duplicates"])) == sorted(i for i, least, _ in brute_links(before) if i == least)


def test_decontamination(spark, stages, sf_dir):
    before = [(i, r.text) for i, r in rows(stages["near_duplicates"]).items()]
    items = [(r.item_id, r.text) for r in table(spark, sf_dir, "benchmark").collect()]
    assert sorted(rows(stages["decontamination"])) == sorted(r[0] for r in brute_hits(before, items) if not r[5])


def test_personal_data(stages):
    before, after = rows(stages["decontamination"]), rows(stages["personal_data"])
    assert sorted(before) == sorted(after)
    for i, r in after.items():
        assert not brute_spans(r.text)
        assert r.n_chars == len(r.text or "")
        if "[" not in r.text:
            assert len(r.text) <= len(before[i].text)
    assert set(sanitise.KINDS) == {"email", "ip", "card", "phone"}


def test_packing(stages):
    lengths: dict[int, int] = {}
    for p in stages["packing"].collect():
        lengths[p.doc_id] = lengths.get(p.doc_id, 0) + p.length
    assert lengths == {i: len(direct("byte_bpe_50k.json", r.text)) + 1 for i, r in rows(stages["personal_data"]).items()}


def test_run_equals_the_stages(spark, sf_dir, stages):
    key = lambda p: (p.doc_id, p.start, p.length, p.ids_crc32)
    whole = corpus_pipeline.run(spark, sf_dir)
    assert whole.columns == stages["packing"].columns
    assert sorted(map(key, whole.collect())) == sorted(map(key, stages["packing"].collect()))


def test_toxicity(spark, stages, sf_dir):
    before = stages["documents"]
    rejected = {r.doc_id for r in toxicity.score(before, table(spark, sf_dir, "labels")).where("predicted = 1").collect()}
    assert sorted(rows(stages["toxicity"])) == sorted(set(rows(before)) - rejected)


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_odd_rows(spark, sf_dir, name):
    """Nulls, repeated rows and ids, a long text, clashing columns; and an empty table."""
    text = "some words that stand in a text of more than a few words"
    odd = [(1, text), (1, text), (2, text), (1, "another text under the same id, quite short"), (None, "a text without any id at all"), (None, None), (3, None), (4, ""), (5, "long words " * 30_000)]
    odd = [(i, t, None if t is None else len(t), i, "x") for i, t in odd]
    docs = spark.createDataFrame(odd, "doc_id long, text string, n_chars long, doc_key long, row string")
    stage = dict(corpus_pipeline.STAGES)[name]
    got = stage(spark, docs, sf_dir)
    kept = [tuple(r) for r in got.collect()]
    assert stage(spark, docs.limit(0), sf_dir).count() == 0
    if name == "packing":
        assert {p[0] for p in kept} == {1, 2, 3, 4, 5, None}
        return
    assert got.columns == docs.columns
    once = [odd[0], *odd[3:]]  # copies of one text: the row of the smallest id
    want = once if name == "near_duplicates" else odd
    assert sorted(kept, key=str) == sorted(want, key=str)
