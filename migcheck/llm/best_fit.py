"""Best-fit packing of documents into sequences, cutting only what no sequence can hold.

Texts are encoded where they lie; only documents longer than a sequence are cut, into full pieces and a
last one.  The pieces are stored, dealt at random (by a hash of their place in the stored table) into
groups of many pieces, and each group is packed by best-fit decreasing: a segment tree over remaining
capacities finds the open sequence with the least room that is enough, in logarithmic time a piece.
Every task packs its own groups, so nothing is held but one group of bounded rows and bytes, and a task
that runs again gives the same sequences.

Defined cases: a null text is an empty one (one end id); repeated ids and rows stay separate documents;
equal lengths are placed in the order of the deal; a text of any length is encoded whole; an empty table
gives no pieces; further columns of the documents are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from migcheck.llm.shared import materialise, sliced
from migcheck.llm.tokenize import PieceEncoder

PIECES = "doc_id long, piece int, start long, length long, ids binary"

#: A group is packed when it has so many pieces, or so many bytes of all their columns.
GROUP_PIECES = 500_000
GROUP_BYTES = 64 << 20


class TightestFit:
    """Open sequences by the room left in them, below a segment tree that counts them."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.leaves = 1 << capacity.bit_length()
        self.open = [0] * (2 * self.leaves)  # of each node: open sequences below it
        self.with_room: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.sequences = 0

    def _count(self, room: int, change: int) -> None:
        at = room + self.leaves
        while at:
            self.open[at] += change
            at >>= 1

    def tightest(self, size: int) -> int | None:
        """The least room of at least ``size`` that an open sequence has."""
        at = size + self.leaves
        if not self.open[at]:
            while at > 1 and (at & 1 or not self.open[at + 1]):  # up, until a right neighbour has some
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if self.open[2 * at] else 2 * at + 1
        return at - self.leaves

    def place(self, size: int) -> tuple[int, int]:
        """(sequence, offset) for a piece of ``size``; a new sequence where none has the room."""
        room = self.tightest(size)
        if room is None:
            sequence, room = self.sequences, self.capacity
            self.sequences += 1
        else:
            sequence = self.with_room[room].pop()
            self._count(room, -1)
        if room > size:
            self.with_room[room - size].append(sequence)
            self._count(room - size, 1)
        return sequence, self.capacity - room


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Sequence and offset of each piece, and the number of sequences; equal sizes keep their order."""
    fit = TightestFit(capacity)
    order = np.argsort(-sizes, kind="stable")
    placed = np.array([fit.place(size) for size in sizes[order].tolist()], dtype=np.int64).reshape(-1, 2)
    out = np.empty_like(placed)
    out[order] = placed
    return out[:, 0], out[:, 1], fit.sequences


def encode(docs: DataFrame, tokenizer: str, end_id: int, length: int = 2048) -> DataFrame:
    """:data:`PIECES` of ``docs`` (doc_id, text); ``ids`` are little-endian unsigned 32-bit."""
    end, width = np.array([end_id], dtype="<u4").tobytes(), 4 * length
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
    names = ["doc_id", "piece", "start", "length", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PieceEncoder.of(tokenizer)
        for batch in sliced(batches):
            doc_ids = batch["doc_id"].to_pylist()
            for first, coded in encoder.runs(batch["text"].to_pylist()):
                rows = [
                    (doc, at // width, at // 4, min(width, len(ids) - at) // 4, ids[at : at + width])
                    for doc, ids in zip(doc_ids[first:], (ids + end for ids in coded))
                    for at in range(0, len(ids), width)
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECES)


def place(pieces: DataFrame, capacity: int = 2048, seed: int = 29) -> DataFrame:
    """``pieces`` (with a ``length`` of 1 to ``capacity`` each) with sequence_id and offset, for the columns at hand.

    The rows are stored first, so that the deal does not change when a lost task runs again.
    """
    pieces = materialise(pieces.drop("sequence_id", "offset"), "pieces")
    rows = pieces.withColumn("deal_", F.xxhash64(F.monotonically_increasing_id(), F.lit(seed)))
    rows = rows.repartition("deal_").sortWithinPartitions("deal_").drop("deal_")
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 40
        group: list[pa.RecordBatch] = []
        n = size = 0

        def packed() -> Iterator[pa.RecordBatch]:
            nonlocal first, group, n, size
            table = pa.Table.from_batches(group)
            sequence, offset, sequences = best_fit_decreasing(table["length"].to_numpy(), capacity)
            table = table.append_column("sequence_id", pa.array(sequence + first)).append_column("offset", pa.array(offset))
            first, group, n, size = first + sequences, [], 0, 0
            yield from table.to_batches(max_chunksize=2_000)

        for batch in batches:
            group.append(batch)
            n, size = n + batch.num_rows, size + batch.nbytes
            if n >= GROUP_PIECES or size >= GROUP_BYTES:
                yield from packed()
        if n:
            yield from packed()

    return rows.mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer: str, end_id: int, length: int = 2048) -> DataFrame:
    """``docs`` to pieces with their ids and their places: :data:`PIECES`, sequence_id, offset."""
    return place(encode(docs, tokenizer, end_id, length), length)
