"""Tables behind connectors: JDBC databases, files, parquet; and load sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from migcheck.operators.comparing import one_per_key
from migcheck.sources import copybook, flatfiles
from migcheck.sources.jdbc import jdbc_url, read_jdbc

def read_copybook(spark: SparkSession, config: dict, query: str) -> DataFrame:
    with open(config["copybook"]) as file:
        fields = copybook.parse(file.read())
    if config.get("records"):
        return flatfiles.read_records(spark, config["path"], fields, config.get("encoding", "ascii"))
    return flatfiles.read_fixed_width(spark, config["path"], fields)


def read_csv(spark: SparkSession, config: dict, query: str) -> DataFrame:
    return flatfiles.read_delimited(spark, config["path"], config.get("delimiter"))


def read_parquet(spark: SparkSession, config: dict, query: str) -> DataFrame:
    return spark.read.parquet(config["path"])


__all__ = ["full_load", "jdbc_url", "read_source", "upsert"]

Reader = Callable[[SparkSession, dict, str], DataFrame]
READERS: dict[str, Reader] = {
    "postgres": read_jdbc, "postgresql": read_jdbc, "db2": read_jdbc, "oracle": read_jdbc, "derby": read_jdbc, "jdbc": read_jdbc,
    "flatfile": read_copybook, "copybook": read_copybook, "csv": read_csv, "parquet": read_parquet,
}


def read_source(spark: SparkSession, config: dict, query: str = "", more: dict[str, Reader] | None = None) -> DataFrame:
    """The table that ``config`` (with a ``type``) names; ``more`` adds readers."""
    readers = READERS | (more or {})
    if config.get("type") not in readers:
        raise ValueError(f"unknown source type {config.get('type')!r}; available: {', '.join(sorted(readers))}")
    return readers[config["type"]](spark, config, query)


def full_load(df: DataFrame, path: str) -> int:
    """Replace a table's files by ``df`` and count what was written."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path).count()


def upsert(current: DataFrame, changes: DataFrame, key: str, order: list | None = None) -> DataFrame:
    """``current`` with the rows of ``changes`` in place of those of the same key.

    Of changes that repeat a key one counts: the first by ``order``, else by all columns, largest first.
    """
    last = one_per_key(changes, key, order or [F.col(c).desc_nulls_last() for c in changes.columns if c != key] or [F.lit(0)])
    return current.join(last.select(key), key, "left_anti").unionByName(last)
