"""The operators of this subpackage bound to the driver tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from migcheck.llm import best_fit, collocations, decontaminate, jaccard_join, license_scan, oracles, packing, repetition, sanitise, sharding, spelling, token_orc, toxicity, warc
from migcheck.llm.shared import materialise, shared_dir, table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, written as ORC and summed up from the files read back."""
    path = shared_dir(spark, "token-orc")
    docs = table(spark, sf_dir, "documents")
    token_orc.write(token_orc.encode(docs, tokenizer_path("word_bpe_49k.json"), end_id=2), path)
    stored = token_orc.read(spark, path)
    return token_orc.with_start(token_orc.checksums(stored), stored).select("doc_id", "start", "n_tokens", "ids_crc32")


def binary_crc32(df: DataFrame, column: str, name: str) -> DataFrame:
    """Replace a binary column by its CRC-32."""
    return df.withColumn(name, F.crc32(column)).drop(column)


def op2_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of all documents, with the words that disclose it."""
    return sanitise.digest(sanitise.find(table(spark, sf_dir, "documents")))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class and number of links of all documents."""
    return jaccard_join.join(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def packed_pieces(docs: DataFrame) -> DataFrame:
    """Pieces in sequences of at most 2048 tokens, with checksums in place of their ids."""
    pieces = packing.pack(docs, tokenizer_path("byte_bpe_50k.json"), end_id=1)
    return binary_crc32(pieces, "ids", "ids_crc32").select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens."""
    return packed_pieces(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibrated toxicity of all documents."""
    scored = toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted", "hit_density", "near_second_person", "obfuscated_hits")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of all pages with resolved revisits, read back record by record."""
    path = shared_dir(spark, "warc")
    warc.write(warc.resolve(table(spark, sf_dir, "pages")), path)
    return warc.read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of nearly equal bytes, over a stored slot map."""
    placed = sharding.records(table(spark, sf_dir, "documents"))
    cells = materialise(sharding.cells_of(placed), "cells")
    path = shared_dir(spark, "slot-map")
    sharding.save_map(sharding.first_map(sharding.slot_sizes(cells), shards=16), path)
    assigned = sharding.assign(placed, cells, sharding.load_map(spark, path))
    return assigned.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        F.col("position").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
    )


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and template matches of all documents."""
    return license_scan.scan(table(spark, sf_dir, "documents")).drop("blocks")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages in all documents."""
    docs = table(spark, sf_dir, "documents")
    matches = decontaminate.find(docs, table(spark, sf_dir, "benchmark"))
    return decontaminate.judge(docs, matches).drop("doc_key")


def op10_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repetition measures and verdict of all documents."""
    return repetition.judge(repetition.measure(table(spark, sf_dir, "documents"))).drop("spans")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with their spelling variants."""
    return spelling.group(table(spark, sf_dir, "documents"))


def op12_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in as few sequences of at most 2048 tokens as best fit gives."""
    pieces = best_fit.encode(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=0)
    return best_fit.place(binary_crc32(pieces, "ids", "ids_crc32")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best phrases of each language in all documents."""
    return collocations.mine(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_orc": op1_token_orc,
    "op2_sanitise": op2_sanitise,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_packing": op4_packing,
    "op5_toxicity": op5_toxicity,
    "op6_warc": op6_warc,
    "op7_sharding": op7_sharding,
    "op8_license_scan": op8_license_scan,
    "op9_decontaminate": op9_decontaminate,
    "op10_repetition": op10_repetition,
    "op11_spelling": op11_spelling,
    "op12_best_fit": op12_best_fit,
    "op13_collocations": op13_collocations,
}

ORACLES: dict[str, str] = {
    "op3_jaccard_join": oracles.JACCARD,
    "op6_warc": oracles.WARC,
    "op9_decontaminate": oracles.DECONTAMINATE,
    "op11_spelling": oracles.SPELLING,
    "op13_collocations": oracles.COLLOCATIONS,
}
