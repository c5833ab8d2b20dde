"""Token-ID output and packing against the tokenizers library used directly."""

from __future__ import annotations

import functools
import random
import zlib

import numpy as np
import pytest

from migcheck.llm import packing, queries, token_orc
from migcheck.llm.shared import shared_dir
from migcheck.llm.tokenize import PieceEncoder

ODD = [
    None, "", " ", "\n", "\n\n", "  two  blanks ", "tab\tand\r\nline", "nb space  em", "it's we'll 'S",
    "a.\x1cb c", "café ́x", "ΟΔΟΣ ΣΑΣ", "<|endoftext|> <|startoftext|>x", "123 4567  89", "x" * 5000,
    "...,, !?\n !", "word\n next\n\n\nline  \n", "İstanbul Ǆ", "日本語 テキスト", "👍🏽 ok", "hello <|endoftext|> world", "x<|endoftext|>y", "<|ENDOFTEXT|>", "word### a&&& 'tis x's.",
]


@functools.cache
def library(name: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path(name))


def direct(name: str, text: str | None) -> list[int]:
    return library(name).encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_pieces_equal_whole_texts(name, spark, sf_dir):
    texts = ODD + [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").limit(60).collect()]
    got = PieceEncoder(queries.tokenizer_path(name)).encode(texts)
    for text, ids in zip(texts, got):
        assert np.frombuffer(ids, "<u4").tolist() == direct(name, text), repr(text)[:80]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_units_of_mixed_signs(name):
    rng = random.Random(1)
    parts = [*ODD[3:10], "<|endoftext|>", "<|", "'s", "'", "It's", "é", "é", "e\u0301", "\u0301", "...", ",", "12", "_", "x_y", "\n", " ", "  ", "\t", "Word", "word.", "'ll", "ª", "×", "ﬁ"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 12))) for _ in range(5000)]
    for text, ids in zip(texts, PieceEncoder(queries.tokenizer_path(name)).encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == direct(name, text), repr(text)


def odd_docs(spark):
    rows = [(i * 3 % 40, t, "x") for i, t in enumerate(ODD)] + [(5, "again", "y"), (5, "again", "y"), (None, "no id", "z"), (77, "long text, " * 100_000, "l")]
    return spark.createDataFrame(rows, "doc_id long, text string, part string")


def test_orc_round_trip(spark):
    docs = odd_docs(spark)
    path = shared_dir(spark, "t-orc")
    token_orc.write(token_orc.encode(docs, queries.tokenizer_path("word_bpe_49k.json"), 2, partitions=4), path)
    stored = token_orc.read(spark, path)
    rows = token_orc.with_start(token_orc.checksums(stored), stored).orderBy("start").collect()
    assert len(rows) == docs.count()
    ids = [-1 if r.doc_id is None else r.doc_id for r in rows]
    assert ids == sorted(ids)
    at = 0
    expected = sorted(
        (-1 if r.doc_id is None else r.doc_id, *_sum(direct("word_bpe_49k.json", r.text) + [2])) for r in docs.collect()
    )
    for r in rows:
        assert r.start == at
        at += r.n_tokens
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == expected


def _sum(ids):
    return len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def test_orc_prunes_by_id(spark, sf_dir):
    path = shared_dir(spark, "t-orc")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    token_orc.write(token_orc.encode(docs, queries.tokenizer_path("word_bpe_49k.json"), 2), path)
    one = token_orc.read(spark, path, where=token_orc.F.col("doc_id") == 7)
    assert "EqualTo(doc_id,7)" in one._jdf.queryExecution().toString()
    assert one.count() == 1


def test_orc_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    path = shared_dir(spark, "t-orc")
    token_orc.write(token_orc.encode(docs, queries.tokenizer_path("word_bpe_49k.json"), 2), path)
    stored = token_orc.read(spark, path)
    assert token_orc.with_start(token_orc.checksums(stored), stored).count() == 0


def test_first_fit_decreasing_is_first_fit():
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 101, 400).tolist()
    room: list[int] = []
    slow = {}
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        at = next((b for b, r in enumerate(room) if r >= sizes[i]), None)
        if at is None:
            at = len(room)
            room.append(100)
        slow[i] = (at, 100 - room[at])
        room[at] -= sizes[i]
    assert packing.first_fit_decreasing(sizes, 100) == [slow[i] for i in range(len(sizes))]
    assert packing.first_fit_decreasing([], 100) == []


def check_pieces(pieces, docs, length):
    by_doc: dict = {}
    for p in pieces:
        by_doc.setdefault((p.doc_id, p.doc_tokens), []).append(p)
    tokens = 0
    for (doc, total), own in by_doc.items():
        tokens += sum(p.length for p in own)
        assert sum(p.length for p in own) % total == 0
    by_seq: dict = {}
    for p in pieces:
        assert len(p.ids) == 4 * p.length > 0
        by_seq.setdefault(p.sequence_id, []).append(p)
    for own in by_seq.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= length
    return tokens, len(by_seq)


def test_packing_keeps_every_id(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(odd_docs(spark).selectExpr("doc_id + 100000 AS doc_id", "text"))
    pieces = packing.pack(docs, queries.tokenizer_path("byte_bpe_50k.json"), 1, length=256, group_tokens=50_000).collect()
    tokens, sequences = check_pieces(pieces, docs, 256)
    expected = {}
    for r in docs.collect():
        expected.setdefault(r.doc_id, []).append(direct("byte_bpe_50k.json", r.text) + [1])
    got: dict = {}
    for p in sorted(pieces, key=lambda p: p.start):
        got.setdefault(p.doc_id, []).append(p)
    for doc, texts in expected.items():
        if len(texts) == 1:
            assert b"".join(p.ids for p in got[doc]) == np.array(texts[0], dtype="<u4").tobytes()
    assert tokens == sum(len(t) for ts in expected.values() for t in ts)
    assert tokens / (sequences * 256) > 0.95


def test_packing_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(docs, queries.tokenizer_path("byte_bpe_50k.json"), 1).count() == 0
