"""Further columns whose names operators use themselves do no harm."""

from __future__ import annotations

from pyspark.sql import functions as F

from migcheck.llm import license_scan, packing, queries, repetition, sanitise, sharding, token_orc, warc
from migcheck.llm.shared import shared_dir

NAMES = """row deal part part_start start ids n_tokens doc_key text_key words size shard slot virtual_slot slot_part position labels score
    blocks spans base email term terms payload payload_digest first_id copies n_words kept url record block words_of n""".split()


def clashing(df):
    return df.select("*", *(F.lit(i).alias(name) for i, name in enumerate(NAMES) if name not in df.columns))


def test_documents(spark):
    docs = clashing(spark.createDataFrame([(1, "some text"), (2, None), (2, "all rights reserved a@b.co")], "doc_id long, text string"))
    path = shared_dir(spark, "clash")
    token_orc.write(token_orc.encode(docs, queries.tokenizer_path("word_bpe_49k.json"), 2), path)
    assert token_orc.read(spark, path).count() == 3
    assert packing.pack(docs, queries.tokenizer_path("byte_bpe_50k.json"), 1).count() == 3
    assert license_scan.scan(docs).where("n_base = 1").count() == 1
    assert repetition.judge(repetition.measure(docs)).count() == 3
    placed = sharding.records(docs)
    cells = sharding.cells_of(placed)
    assert sharding.assign(placed, cells, sharding.first_map(sharding.slot_sizes(cells), 4)).count() == 3
    clean = sanitise.sanitise(docs)
    assert clean.columns == docs.columns and clean.where("text LIKE '%[EMAIL]%'").count() == 1
    assert clean.agg(F.sum("email")).first()[0] == 3 * NAMES.index("email")


def test_pages(spark):
    pages = clashing(spark.createDataFrame([(1, "u", "x" * 200), (2, "v", "x" * 200), (3, None, None)], "page_id long, url string, html string"))
    path = shared_dir(spark, "clash-warc")
    warc.write(warc.resolve(pages), path)
    assert sorted((r.page_id, r.record_type) for r in warc.read(spark, path).collect()) == [(1, "response"), (2, "revisit"), (3, "response")]
