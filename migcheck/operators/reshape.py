"""Normalisation and its reverse."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reconstruct_flat(primary: DataFrame, children: list[tuple[DataFrame, str, str]]) -> DataFrame:
    """The flat view: ``primary`` left-joined with (child, primary's column, child's column) in turn."""

    def attach(flat: DataFrame, child: tuple[DataFrame, str, str]) -> DataFrame:
        rows, own, other = child
        joined = flat.join(rows, flat[own] == rows[other], "left")
        return joined if own != other else joined.drop(rows[other])

    return reduce(attach, children, primary)


def unpivot_groups(df: DataFrame, key: str, groups: dict[str, dict[str, str]]) -> DataFrame:
    """Repeated column groups as rows: ``groups`` maps a kind to {new column: old column}; empty ones are left out."""
    names = list(next(iter(groups.values())))
    kinds = F.array(*(F.struct(F.lit(kind).alias("kind"), *(F.col(cols[n]).alias(n) for n in names)) for kind, cols in groups.items()))
    rows = df.select(key, F.explode(kinds).alias("g")).select(key, "g.*")
    filled = reduce(lambda a, b: a | b, (F.coalesce(F.trim(F.col(n).cast("string")), F.lit("")) != "" for n in names))
    return rows.where(filled)


def transform_select(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """A migration's projection: new name -> expression."""
    return df.select(*(c.alias(name) for name, c in columns.items()))


def hashed(column: Column) -> Column:
    return F.sha2(column.cast("string"), 256)


def yes(column: Column) -> Column:
    """Y, YES, T, TRUE and 1 as true, all else (null too) as false."""
    return F.coalesce(F.upper(F.trim(column.cast("string"))).isin("Y", "YES", "T", "TRUE", "1"), F.lit(False))


def prefix_groups(schema: DataFrame, pattern: str = r"^([a-z]{1,4})_", least: int = 3) -> DataFrame:
    """Columns grouped by name prefix; groups under ``least`` columns are leftovers ('')."""
    prefixed = schema.withColumn("prefix", F.regexp_extract("column_name", pattern, 1))
    sizes = prefixed.groupBy("prefix").agg(F.count("*").alias("size"))
    kept = prefixed.join(sizes, "prefix").withColumn("prefix", F.when(F.col("size") >= least, F.col("prefix")).otherwise(""))
    return kept.groupBy("prefix").agg(F.count("*").alias("n_columns"), F.array_join(F.array_sort(F.collect_list("column_name")), ",").alias("columns"))


def numbered(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows in order, numbered from 1, by a distributed top-n rather than a global window."""
    from pyspark.sql import Window as W

    top = df.orderBy(*order).limit(n)
    return top.withColumn("row_number", F.row_number().over(W.orderBy(*order)))  # n rows only
