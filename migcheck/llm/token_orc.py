"""Token-ID output: ORC files that can be read stripe by stripe and pruned by document id.

Layout: documents are range-partitioned and sorted by id, each partition becomes ORC files
whose ``ids`` column is an integer list (integer run-length encoding), with row indexes and a
Bloom filter on ``doc_id``.  Each row also keeps its partition number and its offset within the
partition, so the global token offset needs only one total per partition.

Defined cases: a null text is an empty one (it still gets the end id); null ids come first;
rows with equal ids (repeated rows too) stay separate rows in input order; an empty table gives an
empty result; a text of any length is one row, encoded whole; further columns, whatever their names,
are ignored.  Strings of a tokenizer's special tokens become those tokens, as the library has it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from migcheck.llm.shared import sliced
from migcheck.llm.tokenize import PieceEncoder

STORED = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("part", T.IntegerType()),
        T.StructField("part_start", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids", T.ArrayType(T.IntegerType(), False)),
    ]
)


def encode(docs: DataFrame, tokenizer: str, end_id: int, partitions: int | None = None) -> DataFrame:
    """``docs`` (doc_id, text) to rows of :data:`STORED`, each partition in ascending id order."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "text",
        F.monotonically_increasing_id().alias("row"),  # keeps repeated ids apart and in order
    )
    # nulls first, as in the sort; the row number lets a very frequent id span partitions
    keys = [F.col("doc_id").asc_nulls_first(), F.col("row")]
    rows = rows.repartitionByRange(partitions, *keys) if partitions else rows.repartitionByRange(*keys)
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, start = TaskContext.get().partitionId(), 0
        encoder = PieceEncoder.of(tokenizer)
        for batch in sliced(batches):
            # small batches out: neither side holds the ids of a whole Arrow batch of texts
            for first, coded in encoder.runs(batch["text"].to_pylist()):
                coded = [x + end for x in coded]
                counts = np.array([len(x) // 4 for x in coded], dtype=np.int64)
                ends = np.cumsum(counts)
                offsets = np.concatenate([[0], ends]).astype(np.int32)
                ids = np.frombuffer(b"".join(coded), dtype="<i4")
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["doc_id"].slice(first, len(coded)),
                        pa.array(np.full(len(coded), part, dtype=np.int32)),
                        pa.array(start + ends - counts),
                        pa.array(counts),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids)),
                    ],
                    names=STORED.names,
                )
                start += int(counts.sum())

    return rows.sortWithinPartitions(*keys).select("doc_id", "text").mapInArrow(run, STORED)


def write(tokens: DataFrame, path: str, stripe_bytes: int = 64 << 20, index_rows: int = 10_000) -> None:
    """Write rows of :data:`STORED` as ORC with row indexes and Bloom filters on the id."""
    (
        tokens.write.format("orc")
        .option("orc.compress", "zstd")
        .option("orc.stripe.size", stripe_bytes)
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", index_rows)
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .save(path)
    )


def read(spark: SparkSession, path: str, where: Column | None = None) -> DataFrame:
    """Rows of :data:`STORED`; a condition on ``doc_id`` is pushed to stripe statistics and filters."""
    stored = spark.read.schema(STORED).orc(path)
    return stored if where is None else stored.where(where)


def with_start(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """Add ``start`` to ``rows`` made from ``stored``: the ids of all documents before, over the whole data set.

    Only one total for each write partition meets in one task; their number is the number of
    write tasks, so broadcasting them (16 bytes each) is bounded whatever the data's size.
    """
    totals = stored.groupBy("part").agg(F.sum("n_tokens").alias("part_tokens"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    bases = totals.select(
        F.col("part").alias("base_part"),
        F.coalesce(F.sum("part_tokens").over(before), F.lit(0)).alias("base"),
    )
    return (
        rows.join(F.broadcast(bases), F.col("part") == F.col("base_part"))
        .withColumn("start", F.col("base") + F.col("part_start"))
        .drop("base", "base_part")
    )


def checksums(stored: DataFrame) -> DataFrame:
    """doc_id, part, part_start, n_tokens and the CRC-32 of the stored ids."""
    schema = T.StructType([*STORED.fields[:4], T.StructField("ids_crc32", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch["ids"]
            at = lists.offsets.to_numpy()
            data = np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), dtype="<i4")
            crc = [zlib.crc32(data[a:b]) for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays(
                [*(batch[c] for c in schema.names[:4]), pa.array(crc, pa.int64())], names=schema.names
            )

    return stored.mapInArrow(run, schema)
