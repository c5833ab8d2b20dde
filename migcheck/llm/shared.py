"""What several operators of this subpackage need: shared folders, table reading, word lower-casing."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where all runs in one local process and the session names no shared folder.
LOCAL_DEFAULT = "/tmp/checkpoints"

#: Lower-case words of a text: letters a-z, digits and everything beyond ASCII.
WORD_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh path below the folder that driver and executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = LOCAL_DEFAULT
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back.

    Unlike a cached or locally checkpointed frame, the files outlive any executor.
    """
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; ``lower``, which folds every script, does so on ASCII texts and is cheaper."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, UPPER, UPPER.lower())).otherwise(F.lower(text))


def split_words(text: Column) -> Column:
    """The lower-case words in order, with an empty one first or last where the text begins or ends with a gap.

    Inside ``explode`` Spark evaluates whatever is named twice again and again, so nothing costly is.
    """
    return F.split(ascii_lower(F.coalesce(text, F.lit(""))), WORD_GAP, -1)


def words_of(text: Column) -> Column:
    """Array of lower-case words (null text: no words), in order."""
    return F.filter(split_words(text), lambda word: word != "")


def n_words_of(text: Column) -> Column:
    """How many words a text has."""
    parts = split_words(text)
    return (F.size(parts) - (F.element_at(parts, 1) == "").cast("int") - ((F.size(parts) > 1) & (F.element_at(parts, -1) == "")).cast("int")).cast("long")


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, doc_key, text.

    The pair (doc_id, doc_key) tells rows apart unless both id and text are the same; such rows
    have the same results, so joining on the pair is safe for repeated ids.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.withColumn("doc_key", F.xxhash64("doc_id", "text"))


def same_row(left: DataFrame, right: DataFrame) -> Column:
    """Join condition on the pair made by :func:`keyed`."""
    return (left["doc_key"] == right["doc_key"]) & left["doc_id"].eqNullSafe(right["doc_id"])


#: Rows and bytes up to which a stored table is broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 << 20


def small(df: DataFrame, most: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` (a stored table), marked for broadcast only if it has at most ``most`` rows and ``most_bytes`` bytes.

    The bytes are Spark's own estimate from the files; the rows of stored files are counted in their footers.
    """
    return F.broadcast(df) if is_small(df, most, most_bytes) else df


def is_small(df: DataFrame, most: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> bool:
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size <= most_bytes and df.count() <= most


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` with all columns, but without the rows whose (doc_id, doc_key) is in the stored table ``gone``."""
    names = gone.select(F.col("doc_id").alias("gone_id"), F.col("doc_key").alias("gone_key")).distinct()
    names = small(materialise(names, "gone"))
    rows = with_key(docs)
    return rows.join(names, (rows["doc_key"] == names["gone_key"]) & rows["doc_id"].eqNullSafe(names["gone_id"]), "left_anti").select("row.*")


def with_key(docs: DataFrame) -> DataFrame:
    """doc_id, doc_key of :func:`keyed` and ``row``, which holds all columns, so that no name can clash."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")).alias("doc_key"),
        F.struct("*").alias("row"),
    )


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Arrow batches in slices, so that only some texts are Python objects at a time; unused memory goes back at the end."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    pa.default_memory_pool().release_unused()
