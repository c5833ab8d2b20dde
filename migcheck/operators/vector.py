"""Similarity search over embeddings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors in a block; a task holds two blocks and the products of :data:`STEP` queries at a time.
BLOCK = 1_000
STEP = 100

BLOCKED = "size int, ids binary, values binary"
FOUND = "query_id long, vec_id long, score double"


def blocks(vectors: DataFrame) -> DataFrame:
    """The vectors as rows of up to :data:`BLOCK` ids and their values, each as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                ids = np.array(part["vec_id"].to_pylist(), dtype=np.int64)
                values = np.array(part["embedding"].to_pylist(), dtype=np.float64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([len(ids)], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([values.tobytes()], pa.binary())],
                    names=["size", "ids", "values"],
                )

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.where("vec_id IS NOT NULL AND embedding IS NOT NULL").mapInArrow(run, BLOCKED)


def numbers(values: pa.Scalar, kind: type = np.float64) -> np.ndarray:
    """A binary value as an array that shares its bytes."""
    return np.frombuffer(values.as_buffer(), kind)


def closest(questions: np.ndarray, values: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each question the ids and rounded scores of the ``k`` best rows of ``values``; ties go by id."""
    order = np.argsort(ids, kind="stable")
    ids, turned, found, scores = ids[order], values[order].T, [], []
    for at in range(0, len(questions), STEP):
        dot = questions[at : at + STEP] @ turned
        score = np.copysign(np.floor(np.abs(dot) * 1e4 + 0.5) / 1e4, dot)
        best = np.argsort(-score, axis=1, kind="stable")[:, :k]
        found.append(ids[best])
        scores.append(np.take_along_axis(score, best, 1))
    return np.concatenate(found), np.concatenate(scores)


def top_similar(vectors: DataFrame, queries: DataFrame, k: int, above: float | None = None) -> DataFrame:
    """query_id, vec_id, score, rank of the ``k`` vectors with the largest dot products with each row of ``queries``, those ``above`` a score only.

    Scores are rounded to four places, ties go by id.  Blocks of queries meet blocks of vectors; each
    pair gives at most ``k`` rows a query.  Rows without an id or an embedding are left out.
    """

    def pair(batch: pa.RecordBatch, at: int) -> pa.RecordBatch:
        q_size, q_ids, q_values, size, ids, values = (c[at] for c in batch.columns)
        others, score = closest(numbers(q_values).reshape(q_size.as_py(), -1), numbers(values).reshape(size.as_py(), -1), numbers(ids, np.int64), k)
        columns = [np.repeat(numbers(q_ids, np.int64), score.shape[1]), others.ravel(), score.ravel()]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                yield pair(batch, at)
            del batch  # before the next one is read

    asked = blocks(queries).select(*(F.col(c).alias(f"query_{c}") for c in ("size", "ids", "values")))
    found = asked.crossJoin(blocks(vectors)).mapInArrow(run, FOUND)
    found = found if above is None else found.where(F.col("score") > above)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
