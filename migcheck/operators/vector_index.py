"""An inverted-file index over vectors: centroids, and every vector stored in the cell of its nearest one.

Centroids are fitted on a bounded sample (:data:`SAMPLE` vectors, those with the least hashes of their ids);
everything else covers all rows.  Cells are stored as blocks of vectors; a cell with many rows is dealt out
over parts, so that no task takes a whole hot cell.  A search sends each query to its nearest cells, meets
their blocks by an equi-join on cell and part, and keeps the best rows of each block.  An exact search goes
on to every further cell whose bound allows a better row: no vector x of a cell with centroid c and radius
r can have a dot product with q above q.c + |q| r.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from migcheck.operators.vector import closest, numbers

#: Vectors the centroids are fitted on.
SAMPLE = 20_000

#: Cells at most, so that centroids and radii are a bounded table.
MOST_CELLS = 4_096

#: Vectors of a block, and of one part of a cell.
BLOCK = 1_000
PART = 8_000

#: Bytes of distances, or of rows for the cells of queries, made at a time; they don't grow with the number of cells.
STEP = 8_000_000

#: Queries that tell how many cells a search needs.
TRIALS = 200

FOUND = "query_id long, cell int, vec_id long, score double"
BLOCKED = "cell int, part int, size int, ids binary, values binary"


@dataclass
class Index:
    """A stored index: ``cells`` (cell, centroid, radius, parts) and ``blocks`` (:data:`BLOCKED`) below ``path``."""

    spark: SparkSession
    path: str
    cosine: bool

    def __post_init__(self):
        rows = self.spark.read.parquet(f"{self.path}/cells").orderBy("cell").collect()  # MOST_CELLS at most
        self.centroids = np.array([r.centroid for r in rows], dtype=np.float64)
        self.radii = np.array([r.radius for r in rows])
        self.parts = self.spark.read.parquet(f"{self.path}/cells").select("cell", "parts")

    @property
    def blocks(self) -> DataFrame:
        return self.spark.read.schema(BLOCKED).parquet(f"{self.path}/blocks")


def unit(values: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(values, axis=1, keepdims=True)
    return np.divide(values, length, out=np.zeros_like(values), where=length > 0)


def rows_of(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding of the rows that have both."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.where("vec_id IS NOT NULL AND embedding IS NOT NULL")


def matrix(batch: pa.RecordBatch, cosine: bool) -> np.ndarray:
    lists = batch["embedding"]
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)
    return unit(values) if cosine else values


def nearest(values: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row, and its distance."""
    cell, step = np.zeros(len(values), np.int64), max(1, STEP // (8 * max(1, len(centroids))))
    far, length = np.zeros(len(values)), (centroids**2).sum(1)
    for at in range(0, len(values), step):
        some = values[at : at + step]
        cell[at : at + step] = near = (length - 2 * some @ centroids.T).argmin(1)
        far[at : at + step] = np.linalg.norm(some - centroids[near], axis=1)
    return cell, far


def steps(batches: Iterator[pa.RecordBatch], cells: int) -> Iterator[pa.RecordBatch]:
    """Slices of the batches, of so many queries that a row for each of ``cells`` takes :data:`STEP` bytes at most, or one query."""
    for batch in batches:
        if batch.num_rows and cells:
            width = len(batch["embedding"].flatten()) // batch.num_rows
            step = max(1, STEP // (8 * cells * max(1, width)))
            for at in range(0, batch.num_rows, step):
                yield batch.slice(at, step)


def fit(vectors: DataFrame, cells: int, cosine: bool, rounds: int = 12) -> np.ndarray:
    """Centroids of a bounded sample by k-means, seeded with evenly spaced rows of it."""
    sample = rows_of(vectors).orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("embedding").toArrow().combine_chunks()
    if not sample.num_rows:
        return np.zeros((0, 0))
    values = matrix(sample.to_batches()[0], cosine)
    cells = min(cells, len(values))
    centroids = values[np.linspace(0, len(values) - 1, cells).astype(int)].copy()
    for _ in range(rounds):
        cell, _ = nearest(values, centroids)
        total = np.zeros_like(centroids)
        np.add.at(total, cell, values)
        n = np.bincount(cell, minlength=cells)[:, None]
        centroids = np.where(n > 0, total / np.maximum(n, 1), centroids)
    return centroids


def blocked(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """Rows (cell, id, values) as blocks of up to :data:`BLOCK` of one cell and part; ``parts`` (cell, parts) is a row a cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int, int] | None = None
        ids: list[int] = []
        values: list[bytes] = []

        def out() -> pa.RecordBatch:
            columns = [[held[0]], [held[1]], [len(ids)], [np.array(ids, np.int64).tobytes()], [b"".join(values)]]
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["cell", "part", "size", "ids", "values"])

        for batch in batches:
            for cell, part, id_, value in zip(*(batch[c].to_pylist() for c in ("cell", "part", "id", "values"))):
                if ids and ((cell, part) != held or len(ids) == BLOCK):
                    yield out()
                    ids, values = [], []
                held = cell, part
                ids.append(id_)
                values.append(value)
        if ids:
            yield out()

    dealt = rows.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    return dealt.repartition("cell", "part").sortWithinPartitions("cell", "part", "id").select("cell", "part", "id", "values").mapInArrow(run, BLOCKED)


def build(vectors: DataFrame, path: str, cells: int | None = None, cosine: bool = False) -> Index:
    """Fit, assign all vectors (vec_id, embedding) and store the index; rows without an id or an embedding are left out."""
    spark = vectors.sparkSession
    if cells is None:
        cells = int(np.sqrt(rows_of(vectors).count()))
    centroids = fit(vectors, max(1, min(cells, MOST_CELLS)), cosine)
    held = spark.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                values = matrix(batch, cosine)
                cell, far = nearest(values, held.value)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cell.astype(np.int32)), batch["vec_id"], pa.array([v.tobytes() for v in values], pa.binary()), pa.array(far)], names=["cell", "id", "values", "far"]
                )

    rows_of(vectors).mapInArrow(run, "cell int, id long, values binary, far double").write.parquet(f"{path}/assigned")
    assigned = spark.read.parquet(f"{path}/assigned")
    sizes = assigned.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("radius"))
    known = {r.cell: r for r in sizes.collect()}  # MOST_CELLS at most
    table = [(i, c.tolist(), float(known[i].radius), int(-(-known[i].n // PART))) for i, c in enumerate(centroids) if i in known]
    spark.createDataFrame(table, "cell int, centroid array<double>, radius double, parts int").coalesce(1).write.parquet(f"{path}/cells")
    blocked(assigned.select("cell", "id", "values"), spark.read.parquet(f"{path}/cells").select("cell", "parts")).write.parquet(f"{path}/blocks")
    return Index(spark, path, cosine)


def routed(index: Index, queries: DataFrame, probes: int) -> DataFrame:
    """cell, id, values, place: each query's first ``probes`` cells in the order of the dot products with their centroids."""
    held = index.spark.sparkContext.broadcast(index.centroids)
    names = index.spark.sparkContext.broadcast([r.cell for r in index.parts.orderBy("cell").collect()])
    cosine = index.cosine

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.array(names.value, dtype=np.int32)
        for batch in steps(batches, len(cells)):
            values = matrix(batch, cosine)
            order = np.argsort(-(values @ held.value.T), axis=1, kind="stable")[:, :probes]
            ids, width = np.array(batch["vec_id"].to_pylist()), order.shape[1]
            raw = [v.tobytes() for v in values]
            columns = [pa.array(cells[order].ravel()), pa.array(np.repeat(ids, width)), pa.array([v for v in raw for _ in range(width)], pa.binary())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.tile(np.arange(width, dtype=np.int32), len(ids)))], names=["cell", "id", "values", "place"])

    return rows_of(queries).mapInArrow(run, "cell int, id long, values binary, place int")


def further(index: Index, queries: DataFrame, reached: DataFrame, probes: int) -> DataFrame:
    """cell, id, values: the cells beyond the first ``probes`` that may hold a row as good as ``reached`` (vec_id, least: a query's k-th score, or null)."""
    held = index.spark.sparkContext.broadcast((index.centroids, index.radii))
    names = index.spark.sparkContext.broadcast([r.cell for r in index.parts.orderBy("cell").collect()])
    cosine = index.cosine

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.array(names.value, dtype=np.int32)
        centroids, radii = held.value
        for batch in steps(batches, len(cells)):
            values = matrix(batch, cosine)
            dots = values @ centroids.T
            bound = dots + np.linalg.norm(values, axis=1, keepdims=True) * radii
            least = np.array([-np.inf if x is None else x for x in batch["least"].to_pylist()])
            may = bound >= least[:, None] - 1e-4  # scores are rounded to four places
            np.put_along_axis(may, np.argsort(-dots, axis=1, kind="stable")[:, :probes], False, axis=1)
            at, cell = np.nonzero(may)
            ids, raw = np.array(batch["vec_id"].to_pylist()), [v.tobytes() for v in values]
            yield pa.RecordBatch.from_arrays([pa.array(cells[cell]), pa.array(ids[at]), pa.array([raw[i] for i in at], pa.binary())], names=["cell", "id", "values"])

    rows = rows_of(queries).join(reached, "vec_id", "left").select("vec_id", "embedding", "least")
    return rows.mapInArrow(run, "cell int, id long, values binary")


def scored(index: Index, asked: DataFrame, k: int) -> DataFrame:
    """:data:`FOUND`: up to ``k`` rows of every block for each query of ``asked`` (cell, id, values) sent to its cell."""

    def pair(batch: pa.RecordBatch, at: int) -> pa.RecordBatch:
        cell, q_size, q_ids, q_values, size, ids, values = (c[at] for c in batch.columns)
        others, score = closest(numbers(q_values).reshape(q_size.as_py(), -1), numbers(values).reshape(size.as_py(), -1), numbers(ids, np.int64), k)
        columns = [np.repeat(numbers(q_ids, np.int64), score.shape[1]), np.full(score.size, cell.as_py(), np.int32), others.ravel(), score.ravel()]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "cell", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                yield pair(batch, at)
            del batch  # before the next one is read

    questions = blocked(asked, index.parts).select("cell", *(F.col(c).alias(f"query_{c}") for c in ("size", "ids", "values")))
    spread = questions.join(F.broadcast(index.parts), "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = spread.join(index.blocks, ["cell", "part"]).select("cell", "query_size", "query_ids", "query_values", "size", "ids", "values")
    return met.mapInArrow(run, FOUND)


def best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(index: Index, queries: DataFrame, k: int, probes: int = 8, exact: bool = False, above: float | None = None) -> DataFrame:
    """query_id, cell, vec_id, score, rank, probed: the ``k`` best rows of the ``probes`` nearest cells of each query.

    With ``exact`` all cells that may hold a better row are searched too, and ``probed`` tells which rows
    the first cells gave.  Scores are dot products (of unit vectors if the index is by cosine), rounded to
    four places; ties go by id.
    """
    first = best(scored(index, routed(index, queries, probes).drop("place"), k), k).withColumn("probed", F.lit(True))
    if exact:
        path = f"{index.path}/found-{np.random.default_rng().integers(1 << 62):x}"
        first.write.parquet(path)
        first = index.spark.read.schema(first.schema).parquet(path)
        reached = first.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("least"))
        more = scored(index, further(index, queries, reached, probes), k).withColumn("probed", F.lit(False))
        first = best(first.drop("rank").unionByName(more), k)
    return first if above is None else first.where(F.col("score") > above)


def recall(found: DataFrame) -> DataFrame:
    """n_queries, n_rows, recall of an exact search: the share of its rows that the first cells gave."""
    return found.agg(F.count_distinct("query_id").alias("n_queries"), F.count("*").alias("n_rows"), F.avg(F.col("probed").cast("double")).alias("recall"))


def probes_for(index: Index, vectors: DataFrame, k: int, recall: float = 0.95) -> int:
    """How many cells a search must probe to find a share ``recall`` of the ``k`` best rows.

    It is read off an exact search for :data:`TRIALS` of ``vectors`` (those with the least hashes of their ids).
    """
    trials = rows_of(vectors).orderBy(F.xxhash64("vec_id"), "vec_id").limit(TRIALS)
    exact = search(index, trials, k, probes=1, exact=True)
    places = routed(index, trials, len(index.radii)).select(F.col("id").alias("query_id"), "cell", "place")
    place = exact.join(places, ["query_id", "cell"]).agg(F.percentile("place", F.lit(recall))).first()[0]
    return 1 if place is None else int(np.ceil(place)) + 1
