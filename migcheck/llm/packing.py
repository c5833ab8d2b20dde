"""Packing of documents into fixed-length sequences.

Documents are dealt at random (by a hash) into partitions and, in hash order, into groups of a
bounded number of tokens.  Each group is packed on its own: documents longer than a sequence
give full sequences, what remains is placed by first-fit decreasing, where a tournament tree over
the bins' free room finds the first bin that fits in logarithmic time.  A group is repeated
identically when a task is run again.

Defined cases: a null text is an empty one (one end id); a text longer than a sequence gives several
pieces; repeated ids and rows stay separate documents; equal sizes are placed in hash order; an empty
table gives no pieces; further columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from migcheck.llm.shared import sliced
from migcheck.llm.tokenize import PieceEncoder

PIECE = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("doc_tokens", T.LongType()),
        T.StructField("sequence_id", T.LongType()),
        T.StructField("offset", T.LongType()),
        T.StructField("ids", T.BinaryType()),
    ]
)


class FirstFitTree:
    """First-fit bins: the leaves hold each bin's free room, inner nodes the larger of two."""

    def __init__(self, capacity: int, most_bins: int):
        self.leaves = 1 << max(0, (most_bins - 1).bit_length())
        self.capacity = capacity
        self.room = [0] * (2 * self.leaves)
        self.bins = 0

    def _set(self, leaf: int, room: int) -> None:
        at, tree = leaf + self.leaves, self.room
        tree[at] = room
        while at > 1:
            at >>= 1
            best = max(tree[2 * at], tree[2 * at + 1])
            if tree[at] == best:
                break
            tree[at] = best

    def place(self, size: int) -> tuple[int, int]:
        """The first bin with room for ``size`` (a new one if none has), and the offset in it."""
        tree, at = self.room, 1
        if tree[1] < size:
            leaf, room = self.bins, self.capacity
            self.bins += 1
        else:
            while at < self.leaves:
                at *= 2
                if tree[at] < size:
                    at += 1
            leaf, room = at - self.leaves, tree[at]
        self._set(leaf, room - size)
        return leaf, self.capacity - room


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each item; equal sizes keep their order."""
    tree = FirstFitTree(capacity, max(1, len(sizes)))
    out: list[tuple[int, int]] = [(0, 0)] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        out[i] = tree.place(sizes[i])
    return out


def pack(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    length: int = 2048,
    group_tokens: int = 2_000_000,
    seed: int = 17,
    partitions: int | None = None,
) -> DataFrame:
    """``docs`` (doc_id, text) to pieces (:data:`PIECE`); ``ids`` are little-endian unsigned 32-bit."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("row")
    ).withColumn("deal", F.xxhash64("doc_id", "row", F.lit(seed)))
    rows = rows.repartition(partitions, "deal") if partitions else rows.repartition("deal")
    end = np.array([end_id], dtype="<u4").tobytes()

    def placed(group: list[tuple[int | None, bytes]], first: int) -> tuple[list[pa.RecordBatch], int]:
        width, out, rest, sizes, next_id = 4 * length, [], [], [], first
        for doc, ids in group:
            whole = len(ids) // width * width
            for at in range(0, whole, width):
                out.append((doc, at // 4, length, len(ids) // 4, next_id, 0, ids[at : at + width]))
                next_id += 1
            if whole < len(ids):
                rest.append((doc, whole // 4, len(ids) // 4, ids[whole:]))
                sizes.append((len(ids) - whole) // 4)
        most = -1
        for (doc, at, total, ids), size, (bin_, offset) in zip(rest, sizes, first_fit_decreasing(sizes, length)):
            out.append((doc, at, size, total, next_id + bin_, offset, ids))
            most = max(most, bin_)
        kinds = [pa.int64()] * 6 + [pa.binary()]
        done = [
            pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out[at : at + 500]), kinds)], names=PIECE.names)
            for at in range(0, len(out), 500)
        ]
        return done, next_id + most + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PieceEncoder.of(tokenizer)
        next_id = TaskContext.get().partitionId() << 40
        group: list[tuple[int | None, bytes]] = []
        tokens = 0
        for batch in sliced(batches):
            docs_of = batch["doc_id"].to_pylist()
            for first, coded in encoder.runs(batch["text"].to_pylist()):
                for doc, ids in zip(docs_of[first:], coded):
                    group.append((doc, ids + end))
                    tokens += len(ids) // 4 + 1
                    if tokens >= group_tokens:
                        done, next_id = placed(group, next_id)
                        yield from done
                        group, tokens = [], 0
        if group:
            yield from placed(group, next_id)[0]

    return rows.sortWithinPartitions("deal", "row").select("doc_id", "text").mapInArrow(run, PIECE)
