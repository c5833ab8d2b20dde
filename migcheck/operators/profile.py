"""Column profiles of whole tables in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def unpivoted(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column_name, value) with every value as text, one row for each cell."""
    columns = columns or df.columns
    texts = df.select(*(F.col(f"`{c}`").cast("string").alias(c) for c in columns))
    return texts.unpivot([], columns, "column_name", "value")


def value_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column_name, value, n): the only shuffle of a profile that grows with the table, and it is combined map-side."""
    return unpivoted(df, columns).groupBy("column_name", "value").agg(F.count("*").alias("n"))


def column_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Counts, null and unique percentages, text minimum, maximum and longest length of every column.

    Two aggregations serve all columns; nothing is scanned once per column.
    """
    some = F.col("value").isNotNull()
    rows = F.sum("n")
    nulls = F.coalesce(F.sum(F.when(~some, F.col("n"))), F.lit(0))
    distinct = F.count("value")
    return (
        value_counts(df, columns)
        .groupBy("column_name")
        .agg(
            rows.alias("row_count"),
            nulls.alias("null_count"),
            F.round(nulls * 100 / rows, 2).alias("null_percent"),
            distinct.alias("distinct_count"),
            F.round(distinct * 100 / rows, 2).alias("unique_percent"),
            F.min("value").alias("min_value"),
            F.max("value").alias("max_value"),
            F.max(F.length("value")).cast("long").alias("max_length"),
        )
    )


def value_frequencies(df: DataFrame, columns: list[str] | None = None, top: int = 10) -> DataFrame:
    """The ``top`` most frequent non-empty values of each column, ties by value."""
    order = W.partitionBy("column_name").orderBy(F.desc("n"), "value")
    counts = value_counts(df, columns).where("value IS NOT NULL AND value <> ''")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def null_percentages(df: DataFrame, columns: list[str] | None = None, empty_is_null: bool = False) -> DataFrame:
    """column_name, null_percent (0 for an empty table), from one aggregation over all columns."""
    columns = columns or df.columns

    def percent(name: str) -> Column:
        cell = F.col(f"`{name}`")
        missing = cell.isNull() | (cell.cast("string") == "") if empty_is_null else cell.isNull()
        return F.coalesce(F.try_divide(F.count_if(missing) * 100, F.count("*")), F.lit(0.0)).cast("double").alias(name)

    return df.agg(*(percent(c) for c in columns)).unpivot([], columns, "column_name", "null_percent")


def duplicate_count(df: DataFrame, column: str) -> DataFrame:
    """How many values occur more than once (null counts as a value)."""
    return df.groupBy(column).agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("duplicate_count"))


def extreme_outlier(df: DataFrame, column: str, deviations: float = 5) -> DataFrame:
    """Whether the maximum lies more than ``deviations`` standard deviations above the mean."""
    stats = df.agg(F.avg(column).alias("mean"), F.stddev_samp(column).alias("stddev"), F.max(column).alias("largest"))
    return stats.select(
        F.round("mean", 4).alias("mean"),
        F.round("stddev", 4).alias("stddev"),
        "largest",
        (F.col("largest") > F.col("mean") + deviations * F.col("stddev")).alias("is_extreme"),
    )
