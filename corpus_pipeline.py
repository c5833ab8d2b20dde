"""A corpus pipeline out of the operators of ``migcheck.llm``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next one's ``docs``.  All but the last keep the columns of ``documents``.

Defined cases, for every stage: a null text is an empty one (nulls stay null); a null or repeated id is
no error, rows are told apart by id and text; rows that repeat both are judged alike, and one of them
stays behind the near-duplicate stage; a very long text is handled whole; of equal copies the one with
the smallest id stays; an empty table gives an empty one; further columns, whatever their names, are kept
by all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from migcheck.llm import decontaminate, jaccard_join, sanitise, toxicity
from migcheck.llm.queries import packed_pieces
from migcheck.llm.shared import materialise, table, without


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic."""
    scored = toxicity.score(docs, table(spark, sf_dir, "labels"))
    return without(docs, scored.where("predicted = 1"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return jaccard_join.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that do not hold too much of a benchmark."""
    matches = materialise(decontaminate.find(docs, table(spark, sf_dir, "benchmark")), "matches")
    return without(docs, decontaminate.judge(docs, matches).where("contaminated"))


def remove_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data and the words that disclose it generalised or removed."""
    return sanitise.sanitise(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 tokens."""
    return packed_pieces(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", remove_personal_data),
    ("packing", pack),
]

#: Boosted trees and tokenizers have no SQL form; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to all documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
