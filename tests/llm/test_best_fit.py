"""Best-fit packing against a plain best fit and the tokenizers library."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest

from migcheck.llm import best_fit, queries
from tests.llm.test_clashes import clashing
from tests.llm.test_tokens import direct, odd_docs

NAME = "word_bpe_49k.json"


def plain_best_fit(sizes: list[int], capacity: int) -> int:
    rooms: list[int] = []
    for size in sorted(sizes, reverse=True):
        enough = [room for room in rooms if room >= size]
        if enough:
            rooms.remove(min(enough))
            rooms.append(min(enough) - size)
        else:
            rooms.append(capacity - size)
    return len(rooms)


@pytest.mark.parametrize("seed", range(40))
def test_tree_is_best_fit(seed):
    rng = random.Random(seed)
    capacity = rng.choice([1, 2, 7, 64, 100, 2048])
    sizes = [rng.randint(1, capacity) for _ in range(rng.randint(0, 300))]
    sequence, offset, n = best_fit.best_fit_decreasing(np.array(sizes, dtype=np.int64), capacity)
    assert n == plain_best_fit(sizes, capacity) == len(set(sequence.tolist()))
    taken = defaultdict(list)
    for size, s, o in zip(sizes, sequence.tolist(), offset.tolist()):
        taken[s].append((o, size))
    for runs in taken.values():
        runs.sort()
        assert [o for o, _ in runs] == [sum(size for _, size in runs[:i]) for i in range(len(runs))]
        assert sum(size for _, size in runs) <= capacity


def test_tightest_room_at_every_size():
    fit = best_fit.TightestFit(16)
    for size in (13, 9, 8):  # rooms of 3, 7 and 8
        fit.place(size)
    assert [fit.tightest(size) for size in range(1, 17)] == [3] * 3 + [7] * 4 + [8] + [None] * 8
    assert fit.place(7) == (1, 9) and fit.place(3) == (0, 13) and fit.tightest(9) is None


def check(pieces, documents, capacity):
    """Every document's ids are in its pieces once and in order; sequences have no gap."""
    sequences = defaultdict(list)
    for p in pieces:
        assert p.length * 4 == len(p.ids) and 1 <= p.length <= capacity
        sequences[p.sequence_id].append((p.offset, p.length))
    for runs in sequences.values():
        runs.sort()
        at = 0
        for offset, length in runs:
            assert offset == at
            at += length
        assert at <= capacity
    by_doc = defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
    for doc, texts in documents.items():
        expected = sorted(direct(NAME, text) + [0] for text in texts)
        starts = sorted(by_doc[doc], key=lambda p: (p.piece, p.start))
        assert all(p.start == p.piece * capacity for p in starts)
        assert sum(p.length for p in starts) == sum(map(len, expected))
        if len(texts) == 1:
            assert np.frombuffer(b"".join(p.ids for p in starts), "<u4").tolist() == expected[0]
            assert all(p.length == capacity for p in starts[:-1])
    return len(sequences)


def test_pieces_of_odd_texts(spark):
    docs = odd_docs(spark)
    documents = defaultdict(list)
    for r in docs.collect():
        documents[r.doc_id].append(r.text)
    assert check(best_fit.pack(docs, queries.tokenizer_path(NAME), 0).collect(), documents, 2048) > 1
    assert check(best_fit.pack(clashing(docs), queries.tokenizer_path(NAME), 0, length=64).collect(), documents, 64) > 1


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert best_fit.pack(docs, queries.tokenizer_path(NAME), 0).count() == 0


def test_few_sequences(spark, sf_dir):
    got = queries.QUERIES["op12_best_fit"](spark, sf_dir).collect()
    total, sequences = sum(r.length for r in got), len({r.sequence_id for r in got})
    assert sequences >= -(-total // 2048)
    whole = plain_best_fit([r.length for r in got], 2048)
    assert sequences <= whole + 8  # one part a shuffle partition may end in a sequence of its own
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert len({r.doc_id for r in got}) == docs and sum(r.piece == 0 for r in got) == docs


def test_groups_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(best_fit, "GROUP_PIECES", 50)
    rng = random.Random(3)
    pieces = spark.createDataFrame([(i, rng.randint(1, 100)) for i in range(1000)], "name long, length long")
    got = best_fit.place(pieces, capacity=100).collect()
    assert len(got) == 1000 and {r.name for r in got} == set(range(1000))
    filled = defaultdict(int)
    for r in got:
        filled[r.sequence_id] += r.length
    assert max(filled.values()) <= 100
