"""Phrases against plain counting of all runs of words, and bitmaps against sets of positions."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from migcheck.llm import collocations, oracles, queries
from tests.llm.sql import same_rows
from tests.llm.test_clashes import clashing
from tests.llm.test_spelling import LOWER


@pytest.mark.parametrize("seed", range(30))
def test_bitmaps_are_sets(seed):
    rng = random.Random(seed)
    size = rng.choice([1, 63, 64, 65, 200, 5000])
    draw = lambda: sorted(rng.sample(range(size), rng.randint(1, size)))
    left, right, marks = draw(), draw(), np.array([rng.random() < 0.5 for _ in range(size)])
    a, b = collocations.bitmap(np.array(left)), collocations.bitmap(np.array(right))
    assert collocations.positions(a).tolist() == left and collocations.n_set(a) == len(left)
    assert collocations.positions(collocations.both(a, b)).tolist() == sorted(set(left) & set(right))
    moved = collocations.following(a, collocations.dense(marks))
    assert collocations.positions(moved).tolist() == [p + 1 for p in left if p + 1 < size and marks[p + 1]]
    assert (np.diff(moved[0]) > 0).all() and (moved[1] != 0).all()


def brute(rows, least=30, most=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 5):
                f.update((lang, *words[i : i + k]) for i in range(len(words) - k + 1))
    candidates = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    most_around = defaultdict(int)
    for p, a in candidates.items():
        for size in range(2, len(p) - 1):
            for at in range(1, len(p) - size + 1):
                most_around[p[0], *p[at : at + size]] = max(a, most_around[p[0], *p[at : at + size]])
    found = defaultdict(list)
    for p, a in candidates.items():
        if 100 * most_around.get(p, 0) >= 80 * a and p in most_around:
            continue
        lang, words = p[0], p[1:]
        cuts = []
        for k in range(1, len(words)):
            left, right = f[lang, *words[:k]], f[lang, *words[k:]]
            cuts.append((2000000 * a // (left + right), k, left, right))
        score, _, left, right = min(cuts)
        found[lang].append((-score, -a, " ".join(words).encode(), left, right))
    return {
        (lang, i + 1, phrase.decode(), -a, left, right, n[lang], -score)
        for lang, rows in found.items()
        for i, (score, a, phrase, left, right) in enumerate(sorted(rows)[:most])
    }


def got_of(df):
    return {tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()}


def texts(seed: int, n: int, vocabulary: int):
    rng = random.Random(seed)
    words = [f"W{i}" if i % 3 else f"é{i}'" for i in range(vocabulary)]
    word = lambda: words[min(int(rng.expovariate(0.3)), vocabulary - 1)]
    ends = ["", "", "", "", ".", ",", "\n", "\x0b", "?", "  \t", "\xa0"]
    return [(rng.choice(["en", "de", None, "und"]), " ".join(word() + rng.choice(ends) for _ in range(rng.randint(0, 300)))) for _ in range(n)]


@pytest.mark.parametrize("seed, vocabulary, shard, few", [(1, 12, 16 << 20, 64), (2, 5, 3_000, 3), (3, 40, 200, 0), (4, 3, 20_000, 8)])
def test_equals_plain_counting(spark, monkeypatch, seed, vocabulary, shard, few):
    monkeypatch.setattr(collocations, "SHARD_BYTES", shard)
    monkeypatch.setattr(collocations, "FEW", few)
    rows = texts(seed, 60, vocabulary)
    shards = collocations.shards(iter(_batches(rows)))
    counted = Counter()
    everything = np.full(1 << 12, ~np.uint64(0))
    for part in shards:
        for phrase, n in collocations.phrases_of(part, [everything] * 3, 4):
            counted[part.lang, phrase.decode()] += n
    expected = Counter()
    for lang, text in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", text.translate(LOWER)):
            words = re.findall("[^\x20\x09]+", piece)
            expected.update((lang or "und", " ".join(words[i : i + k])) for k in (2, 3, 4) for i in range(len(words) - k + 1))
    assert counted == expected
    if seed == 1:
        docs = spark.createDataFrame(rows, "lang string, text string")
        assert got_of(collocations.mine(docs, least=20, most=50)) == brute(rows, 20, 50)


def _batches(rows):
    import pyarrow as pa

    return pa.table([pa.array([lang or "und" for lang, _ in rows]), pa.array([t.encode() for _, t in rows])], names=["lang", "text"]).to_batches()


def test_small_bit_tables_change_nothing(spark, monkeypatch):
    rows = texts(7, 40, 9)
    docs = clashing(spark.createDataFrame(rows, "lang string, text string").repartition(5))
    table = collocations.bit_table
    monkeypatch.setattr(collocations, "bit_table", lambda keys: table(keys, 7))
    assert got_of(collocations.mine(docs, least=15)) == brute(rows, 15)


def test_defined_cases(spark):
    rows = [(None, "a b " * 40), ("und", "a b " * 40), ("en", None), ("en", ""), ("en", " .,;\t "), ("en", "x y" * 1), ("fr", "one two three four five " * 40_000)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert got_of(collocations.mine(docs)) == brute(rows)
    assert collocations.mine(docs.where("false")).count() == 0
    assert collocations.mine(docs.where("lang = 'en'")).count() == 0


def test_scores_are_exact_beyond_64_bits(spark):
    big = 9_000_000_000_000_000_000
    counts = spark.createDataFrame([("en", "a", big), ("en", "b", big - 1), ("en", "a b", big - 2), ("en", "b a", big // 2)], "lang string, phrase string, n long")
    got = {r.phrase: r.score for r in collocations.scored(counts).collect()}
    assert got == {"a b": 2000000 * (big - 2) // (2 * big - 1), "b a": 2000000 * (big // 2) // (2 * big - 1)}


def test_query_equals_sql(spark, sf_dir):
    same_rows(queries.QUERIES["op13_collocations"](spark, sf_dir), oracles.COLLOCATIONS, sf_dir)
