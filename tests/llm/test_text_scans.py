"""Licence scan and repetition rules against brute force."""

from __future__ import annotations

import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from migcheck.llm import license_scan, queries, repetition


def brute_repeats(words):
    best = []
    for i in range(len(words)):
        longest = 0
        for j in range(len(words)):
            if i != j:
                k = 0
                while i + k < len(words) and j + k < len(words) and words[i + k] == words[j + k]:
                    k += 1
                longest = max(longest, k)
        best.append(longest)
    return best


def brute_maximal(words, least):
    """How many distinct substrings of at least ``least`` words occur twice and with fewer occurrences once a word is added on either side."""
    count = {}
    for i in range(len(words)):
        for j in range(i + least, len(words) + 1):
            count.setdefault(tuple(words[i:j]), []).append(i)
    out = 0
    for sub, at in count.items():
        if len(at) > 1:
            before = {words[i - 1] if i else None for i in at}
            after = {words[i + len(sub)] if i + len(sub) < len(words) else None for i in at}
            out += len(before) > 1 and len(after) > 1
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=60), st.integers(1, 9))
def test_suffix_array_repeats(words, least):
    text = " ".join(words)
    row = repetition.measure_batch(["x y", text, None], least)[1]
    best = brute_repeats(words)
    cover = set()
    for i, k in enumerate(best):
        if k >= least:
            cover.update(range(i, i + k))
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    twice = {p for v in windows.values() if len(v) > 1 for i in v for p in range(i, i + 8)}
    assert row[7] == brute_maximal(words, least)
    assert row[0] == len(words)
    assert row[4] == len(twice)
    assert row[5] == len(cover)
    assert row[6] == (max(best) if best and max(best) >= least else 0)
    assert {p for a, b in row[8] for p in range(a, b)} == cover


def expected_op10(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    twice = {p for v in windows.values() if len(v) > 1 for i in v for p in range(i, i + 8)}
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(twice),
        len(words) < 20 or 100 * len(twice) > 30 * len(words),
    )


def test_repetition_query(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op10_repetition(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        want = expected_op10(docs[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want
        assert not (r.base_failed and r.kept)
        assert r.covered_words == r.n_repeat_words  # both unite repeats of at least eight words


def test_repetition_odd_texts(spark):
    once = " ".join(f"w{i}" for i in range(150))
    texts = [None, "", "\n \n", "a", once, once + " " + once, "z " * 40000, once + " " + " ".join(f"v{i}" for i in range(600)) + " " + once]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)] + [(None, once, 1)], "doc_id long, text string, kept int")
    got = {r.doc_id: r for r in repetition.judge(repetition.measure(docs)).collect()}
    for i, t in enumerate(texts):
        if i != 6:
            assert (got[i].n_words, got[i].word_chars, got[i].n_symbols, got[i].n_dup_lines, got[i].n_repeat_words, got[i].base_failed) == expected_op10(t)
    assert got[6].longest_repeat == 39999 and not got[6].kept
    assert got[4].kept and got[None].kept and not got[5].kept
    assert not got[7].base_failed or got[7].longest_repeat == 150
    assert not got[7].kept  # one repeat of 150 words
    assert repetition.measure(docs.limit(0)).count() == 0


def brute_license(text):
    own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = []
    for phrase, label in license_scan.PHRASES.items():
        parts = phrase.split()
        places += [(i, label) for i in range(len(own)) if own[i : i + len(parts)] == parts]
    blocks = set()
    for label, t in license_scan.TEMPLATES.items():
        want = {w.decode() for w in license_scan.words(t.encode())}
        span = 2 * len(license_scan.words(t.encode()))
        if len(want & set(own)) < 0.8 * len(want) - 1e-9:
            continue
        run = None
        for k in range(max(0, len(own) - span) + 1):
            met = len(set(own[k : k + span]) & want) / len(want)
            if met >= 0.8 - 1e-12:
                run = (run[0], min(len(own), k + span), max(run[2], met)) if run else (k, min(len(own), k + span), met)
            elif run:
                blocks.add((label, run[0], run[1], round(run[2], 9)))
                run = None
        if run:
            blocks.add((label, run[0], run[1], round(run[2], 9)))
    return own, places, blocks


def test_license_scan_finds_every_block(spark, sf_dir):
    extra = [
        None, "", "CC BY cc by\nALL RIGHTS  reserved.", "İ General Public License É",
        "words " * 50 + license_scan.TEMPLATES["mit-grant"].upper() + " tail" * 70,
        "Redistribution in source, binary forms and use, with modification or without, are permitted provided following conditions met that",
        license_scan.TEMPLATES["bsd"], "w " * 37 + license_scan.TEMPLATES["mit-text"] + " and then " * 400 + license_scan.TEMPLATES["zlib"] * 2, "the the the of of and in " * 300,
    ]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame(list(enumerate(extra, 10**6)), "doc_id long, text string")).withColumn("labels", queries.F.lit(1))
    texts = {r.doc_id: r.text for r in docs.collect()}
    hits = 0
    for r in license_scan.scan(docs).collect():
        own, places, blocks = brute_license(texts[r.doc_id])
        at = [p for p, _ in places]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(own), len(at), min(at, default=None), max(at, default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in places}))
        assert {(b.label, b.from_word, b.to_word, round(b.containment, 9)) for b in r.blocks} == blocks
        assert r.labels == ",".join(sorted({x for _, x in places} | {b[0] for b in blocks}))
        assert r.score == (1.0 if at else max((b.containment for b in r.blocks), default=0.0))
        hits += bool(blocks)
    assert hits > 5


def test_license_scan_empty(spark):
    assert license_scan.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_suffix_levels_order():
    rng = np.random.default_rng(0)
    codes = np.unique(rng.integers(0, 4, 200), return_inverse=True)[1]
    order = np.argsort(repetition.suffix_levels(codes)[-1])
    assert order.tolist() == sorted(range(200), key=lambda i: codes[i:].tolist())


def test_repetition_of_a_few_words():
    for text in ("a", "a b", "a b c", "a a a a a a", "a " * 7, "a " * 8, "a " * 9, ""):
        got = repetition.measure_batch([text], 8)[0]
        want = expected_op10(text)
        assert got[0] == len(text.split()) and got[4] == (9 if text == "a " * 9 else 0), (text, got, want)
