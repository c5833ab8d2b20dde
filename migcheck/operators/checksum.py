"""Checksums of columns and rows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def short_hash(text: Column) -> Column:
    """The first 60 bits of the MD5 of a text, as a number."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("decimal(38,0)")


def column_checksums(df: DataFrame, columns: list[str]) -> DataFrame:
    """column_name, n, checksum: the sum of the hashes of all non-null values.

    Independent of order and combined map-side, so it holds for any number of rows.
    """
    cells = df.select(*(F.col(c).cast("string").alias(c) for c in columns)).unpivot([], columns, "column_name", "value")
    total = F.coalesce(F.sum(short_hash(F.col("value"))), F.lit(0)).cast("string")
    return cells.groupBy("column_name").agg(F.count("value").alias("n"), total.alias("checksum"))


def ordered_md5(df: DataFrame, column: str, most_rows: int = 1_000_000) -> DataFrame:
    """MD5 of all values as one text in order, as databases compute it; only for columns of at most ``most_rows`` rows.

    The text is built in one row, so larger columns are refused: use :func:`streamed_md5` or :func:`column_checksums`.
    """
    if df.count() > most_rows:
        raise ValueError(f"{column} has over {most_rows} rows; use column_checksums")
    ordered = F.transform(F.array_sort(F.collect_list(column)), lambda x: x.cast("string"))
    return df.agg(F.md5(F.array_join(ordered, "").cast("binary")).alias("checksum"))


#: Characters, more or less, that are handed on as one piece of a column's text.
PIECE = 1 << 20


def streamed_md5(df: DataFrame, column: str) -> DataFrame:
    """The checksum of :func:`ordered_md5` for any number of rows.

    The column is sorted by ranges and joined to pieces in parallel; as MD5 runs from front to back, one
    task takes the pieces in order, one at a time.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        range_no, n, held, length = TaskContext.get().partitionId(), 0, [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([range_no], pa.int32()), pa.array([n], pa.int64()), pa.array(["".join(held).encode()], pa.binary())],
                names=["range_no", "n", "piece"],
            )

        for batch in batches:
            for value in batch["value"].to_pylist():
                held.append(value)
                length += len(value)
                if length >= PIECE:
                    yield out()
                    n, held, length = n + 1, [], 0
        if held:
            yield out()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        md5 = hashlib.md5()
        for batch in batches:
            for piece in batch["piece"]:
                md5.update(piece.as_buffer())
        yield pa.RecordBatch.from_arrays([pa.array([md5.hexdigest()])], names=["checksum"])

    ordered = df.where(F.col(column).isNotNull()).orderBy(column).select(F.col(column).cast("string").alias("value"))
    pieces = ordered.mapInArrow(join, "range_no int, n long, piece binary")
    whole = pieces.repartition(1).sortWithinPartitions("range_no", "n").mapInArrow(digest, "checksum string")
    return whole.agg(F.coalesce(F.max("checksum"), F.md5(F.lit("").cast("binary"))).alias("checksum"))


def row_text(columns: list[str]) -> Column:
    """All values of a row as one text.

    Bars and backslashes inside a value are escaped and a null is written as an escape of its own, so that
    different rows never make the same text.
    """

    def written(name: str) -> Column:
        value = F.replace(F.replace(F.col(name).cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))
        return F.coalesce(value, F.lit("\\N"))

    return F.concat_ws("|", *map(written, columns))


def row_checksum(df: DataFrame, columns: list[str]) -> DataFrame:
    """n, checksum of whole rows: each row's values are joined before they are hashed (see :func:`row_text`)."""
    return df.agg(F.count("*").alias("n"), F.coalesce(F.sum(short_hash(row_text(columns))), F.lit(0)).cast("string").alias("checksum"))
