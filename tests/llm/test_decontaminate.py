"""Benchmark decontamination against brute force."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import functions as F

from migcheck.llm import decontaminate, queries

SCHEMA = "doc_id long, text string, words string"


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    windows: dict[tuple, set] = {}
    for item, text in items:
        own = words_of(text)
        size = min(13, len(own))
        for k in range(len(own) - size + 1 if own else 0):
            windows.setdefault(tuple(own[k : k + size]), set()).add(str(item))
    sizes = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        own = words_of(text)
        hit, met = set(), set()
        for size in sizes:
            for k in range(len(own) - size + 1):
                if found := windows.get(tuple(own[k : k + size])):
                    hit.update(range(k, k + size))
                    met |= found
        digest = hashlib.sha256(",".join(sorted(met)).encode()).hexdigest()
        out.append((doc, len(own), len(hit), len(met), digest, len(hit) > 0 and 20 * len(hit) >= len(own)))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect()), key=repr)


def test_query(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    expected = brute(docs, items)
    assert rows_of(queries.op9_decontaminate(spark, sf_dir)) == expected
    assert any(r[5] for r in expected) and not all(r[5] for r in expected)


def odd_tables(spark):
    passage = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"
    items = [(1, passage), (2, "Short Item"), (3, None), (4, " .. "), (5, "same same same same same same same same same same same same same same same"), (5, "another text under one id"), (None, "nameless item here")]
    docs = [
        (1, None), (2, ""), (3, passage), (4, "... " + passage.upper() + "!"), (5, "x " * 300 + passage), (6, "a short item and a short item"),
        (7, "same " * 40), (8, "same " * 12), (9, passage.replace("mu", "MU\x00")), (10, " ".join(passage.split()[2:])), (10, "short item"), (10, "short item"),
        (None, "the nameless item here"), (11, "é" + passage), (12, "another text under one id, short item"),
    ]
    return docs, items


def test_odd_rows(spark):
    docs, items = odd_tables(spark)
    df = spark.createDataFrame([(i, t, "clash") for i, t in docs], SCHEMA)
    bench = spark.createDataFrame([(i, t, "clash") for i, t in items], "item_id long, text string, term string")
    got = rows_of(decontaminate.judge(df, decontaminate.find(df, bench)))
    expected = brute(docs, [("null" if i is None else i, t) for i, t in items])
    assert got == expected


def test_empty_tables(spark):
    docs, items = odd_tables(spark)
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], SCHEMA)
    bench = spark.createDataFrame([(i, t) for i, t in items], "item_id long, text string")
    assert decontaminate.judge(df.limit(0), decontaminate.find(df.limit(0), bench)).count() == 0
    clean = decontaminate.judge(df, decontaminate.find(df, bench.limit(0)))
    assert clean.where("contaminated OR n_hit > 0").count() == 0 and clean.count() == len(docs)


def test_proximity(spark):
    item = "uno dos tres cuatro cinco"
    docs = spark.createDataFrame([(1, "uno dos x tres y cuatro cinco"), (2, "uno " + "x " * 60 + "dos tres cuatro cinco")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    items = decontaminate.items_of(bench)
    terms = items.select(F.explode("item_words").alias("term")).distinct()
    rows = decontaminate.keyed(docs)
    windows = decontaminate.windows_of(items, decontaminate.term_counts(rows, terms), 13, 5)
    adjusted = decontaminate.shifted(decontaminate.postings_of(rows, terms), decontaminate.seeds_of(windows))
    assert {r.doc_id for r in decontaminate.near_matches(adjusted, windows, 8).collect()} == {1}
