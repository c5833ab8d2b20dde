"""Near-duplicate join against brute force."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from migcheck.llm import jaccard_join, queries


def shingles(text):
    own = [w for w in jaccard_join.WORD.findall((text or "").encode().lower())]
    size = min(5, len(own))
    return {tuple(own[k : k + size]) for k in range(len(own) - size + 1)} if own else set()


def brute(rows):
    """(doc_id, class_id, n_links) of rows (doc_id, text), sorted."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))
    links = [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                met = len(sets[i] & sets[j])
                if 5 * met >= 4 * (len(sets[i]) + len(sets[j]) - met):
                    links[i] += 1
                    links[j] += 1
                    root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), doc), doc)
    return sorted((doc, least[find(i)], links[i]) for i, (doc, _) in enumerate(rows))


def variants(rng, base, n, changes):
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(rng.randint(0, changes)):
            own[rng.randrange(len(own))] = f"w{rng.randrange(10**6)}"
        out.append(" ".join(own))
    return out


def test_groups_of_every_size(spark):
    rng = random.Random(3)
    texts = []
    for size in (2, 3, 10, 300):  # the last one fills several blocks
        texts += variants(rng, [f"w{rng.randrange(10**6)}" for _ in range(90)], size, 4)
    texts += ["one two three four five six"] * 40  # exact copies
    texts += [" ".join(f"u{rng.randrange(10**6)}" for _ in range(60)) for _ in range(100)]
    common = " ".join(f"c{i}" for i in range(60))
    texts += [common + " " + " ".join(f"v{rng.randrange(10**6)}" for _ in range(60)) for _ in range(60)]  # a shared passage is no near copy
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted(tuple(r) for r in jaccard_join.join(docs).select("doc_id", "class_id", "n_links").collect())
    assert got == brute(rows)


def odd_rows():
    long = "the quick brown fox jumps over the lazy dog again and again until it is tired of it"
    return [
        (1, None), (2, ""), (3, "..."), (4, "Hello World"), (5, "hello, world!"), (6, "hello"), (7, long), (8, long.upper()), (8, long.upper()),
        (9, long + " of all"), (10, "é è ê ë a"), (11, "É È Ê Ë A"), (12, "x " * 5000), (13, "x x x x x"), (2, ""),
    ]


def test_odd_rows_and_clashing_columns(spark):
    docs = spark.createDataFrame([(i, t, 1, "c") for i, t in odd_rows()], "doc_id long, text string, doc_key int, class_id string")
    got = sorted(tuple(r) for r in jaccard_join.join(docs).select("doc_id", "class_id", "n_links").collect())
    assert got == brute(odd_rows())
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 2, 3, 4, 6, 7, 10, 11, 12]
    same = jaccard_join.keep_one(docs.where("doc_id = 8"))  # of repeated rows one stays
    assert [tuple(r) for r in same.collect()] == [(8, odd_rows()[7][1], 1, "c")]


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_join.join(docs).count() == 0
    assert jaccard_join.keep_one(docs).count() == 0


def test_query(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert sorted(tuple(r) for r in queries.op3_jaccard_join(spark, sf_dir).collect()) == brute(rows)


def test_pruning_keeps_pairs_at_the_threshold():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 900, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[:800], rng.integers(0, 2**63, 100, dtype=np.uint64)])) for _ in range(40)]  # similarity 0.8
    signs = jaccard_join.signatures(sets, jaccard_join.HASHES)
    a, b = np.triu_indices(len(sets), 1)
    assert len(jaccard_join.likely(signs, a, b, 0.8, 1e-6)) == len(a)
    far = [rng.integers(0, 2**63, 500, dtype=np.uint64) for _ in range(10)]
    a, b = np.triu_indices(len(far), 1)
    assert len(jaccard_join.likely(jaccard_join.signatures(far, 96), a, b, 0.8, 1e-6)) == 0


def test_roots_and_components(spark):
    a, b = np.array([1, 2, 5, 7]), np.array([2, 3, 6, 5])
    assert jaccard_join.roots_of(9, a, b).tolist() == [0, 1, 1, 1, 4, 5, 5, 5, 8]
    chain = [(i, i + 1) for i in range(0, 60)] + [(100, 200), (200, 150)]
    edges = spark.createDataFrame(chain, "x int, y int").select(*(F.encode(F.lpad(F.col(c).cast("string"), 4, "0"), "utf-8").alias(n) for c, n in (("x", "a"), ("y", "b"))))
    got = {bytes(r.member).decode(): bytes(r.root).decode() for r in jaccard_join.components(edges, "test").collect()}
    assert got == {f"{i:04}": "0000" for i in range(61)} | {"0100": "0100", "0150": "0100", "0200": "0100"}
