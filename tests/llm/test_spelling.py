"""Spelling variants against all pairs of words, one by one."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest

from migcheck.llm import oracles, queries, spelling
from tests.llm.test_clashes import clashing
from tests.llm.sql import same_rows

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_apart(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) - len(short) == 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute(rows, least_letters=5, least_count=3, every=97):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = 1 if doc is None else zlib.crc32(f"{doc}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % every == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= least_letters and n >= least_count}
    out = {}
    for word, n in words.items():
        near = [o for o in words if one_apart(word, o)]
        best = min(near, key=lambda o: (-words[o], o), default=None)
        out[word] = (n, len(near), *((best, words[best]) if best and words[best] >= 2 * n else (None, None)))

    def root(word):
        while out[word][2]:
            word = out[word][2]
        return word

    return {(w, f, root(w), n, near, fn) for w, (n, near, f, fn) in out.items()}


def got_of(df):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def random_texts(seed: int, letters: str):
    rng = random.Random(seed)
    stems = ["".join(rng.choice(letters) for _ in range(rng.randint(4, 9))) for _ in range(25)]

    def word():
        w = rng.choice(stems)
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            at = rng.randrange(len(w) + 1)
            w = rng.choice([w[:at] + rng.choice(letters) + w[at:], w[:at] + w[at + 1 :], w[:at] + rng.choice(letters) + w[at + 1 :]])
        return rng.choice([w, w, w.capitalize()])

    return [(i, " ".join(word() for _ in range(rng.randint(0, 200)))) for i in range(30)]


@pytest.mark.parametrize("seed, letters", [(1, "ab"), (2, "abc"), (3, "aé×"), (4, "abcdefgh")])
def test_equals_all_pairs(spark, seed, letters):
    rows = random_texts(seed, letters)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got_of(spelling.group(docs, damage_every=7)) == brute(rows, every=7)


def test_defined_cases(spark):
    rows = [(None, "Straße straße STRASSE " * 3), (1, None), (1, ""), (2, "abcde abcdf abcde " * 2), (2, "abcde abcdf abcde " * 2), (3, "ÀBCDE àbcde ÿÿÿÿÿÿ×÷ a b " * 4), (4, "word, longtext " * 30_000)]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got_of(spelling.group(docs)) == brute(rows)
    assert spelling.group(docs.where("false")).count() == 0


def test_hot_halves_are_salted(spark, monkeypatch):
    monkeypatch.setattr(spelling, "PART_ROWS", 3)
    rng = random.Random(5)
    words = sorted({"qzaa" + "".join(rng.choice("aab") for _ in range(rng.randint(1, 6))) for _ in range(200)})
    frame = spark.createDataFrame([(w, 5) for w in words], "word string, n long")
    got = {tuple(sorted((r.left, r.right))) for r in spelling.near_pairs(frame).collect()}
    assert got == {(a, b) for i, a in enumerate(words) for b in words[i + 1 :] if one_apart(a, b)}
    assert spelling.near_pairs(frame).count() == len(got)  # each pair once


def test_long_chains_end(spark):
    frame = spark.createDataFrame([(f"word{i}", f"word{i + 1}" if i < 40 else None) for i in range(41)], "word string, form string")
    assert {r.root for r in spelling.roots(frame).collect()} == {"word40"}


def test_query_equals_sql(spark, sf_dir):
    same_rows(queries.QUERIES["op11_spelling"](spark, sf_dir), oracles.SPELLING, sf_dir)
