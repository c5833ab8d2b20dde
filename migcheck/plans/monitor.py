"""Monitoring against a baseline, and what is worth migrating."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def volume_anomaly(current: Column, baseline: Column, threshold: float = 0.3) -> tuple[Column, Column]:
    """(deviation in per cent, whether it is over the threshold); a baseline of 0 deviates by 100 or 0."""
    deviation = F.when(baseline == 0, F.when(current > 0, 100.0).otherwise(0.0)).otherwise(F.abs(current - baseline) * 100.0 / baseline)
    return F.round(deviation, 2), deviation > threshold * 100


def freshness(df: DataFrame, column: str, now: str, most_hours: float) -> DataFrame:
    """latest, age in hours at ``now`` and whether it is stale; a table without rows is stale."""
    latest = df.agg(F.max(column).alias("latest"))
    hours = (F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(F.col("latest").cast("timestamp"))) / 3600
    return latest.select("latest", F.round(hours, 2).alias("age_hours"), F.coalesce(hours > most_hours, F.lit(True)).alias("stale"))


def usage_score(queries: Column) -> Column:
    return F.when(queries > 0, F.least(F.lit(100.0), 20 + 25 * F.log10(queries))).otherwise(50.0)


def steps(value: Column, bounds: tuple[tuple[float, float], ...], beyond: float) -> Column:
    """The score of the first bound that the value does not exceed."""
    out = F.lit(beyond)
    for most, score in reversed(bounds):
        out = F.when(value <= most, score).otherwise(out)
    return out


def downstream_score(tables: Column) -> Column:
    return steps(tables, ((0, 0.0), (1, 30.0), (3, 55.0), (5, 75.0), (10, 90.0)), 100.0)


def age_score(days: Column) -> Column:
    return F.when(days.isNull(), 25.0).otherwise(steps(days, ((7, 100.0), (30, 85.0), (90, 65.0), (180, 45.0), (365, 25.0)), 10.0))


def completeness(profile: DataFrame, by: str = "table") -> DataFrame:
    """100 less the mean null percentage of a table's columns."""
    return profile.groupBy(by).agg(F.round(F.greatest(F.lit(0.0), 100 - F.avg("null_percent")), 2).alias("completeness"))


def downstream_count(lineage: DataFrame) -> DataFrame:
    """Tables that read each table."""
    return lineage.where("downstream <> ''").groupBy("table").agg(F.count_distinct("downstream").alias("n_downstream"))


def rationalize(stats: DataFrame) -> DataFrame:
    """Score and recommendation from query count, downstream tables, age, completeness and tier score."""
    score = (
        usage_score(F.col("query_count")) * 0.35 + downstream_score(F.col("n_downstream")) * 0.25 + age_score(F.col("age_days")) * 0.2
        + F.col("completeness") * 0.1 + F.col("tier_score") * 0.1
    )
    scored = stats.withColumn("score", F.round(score, 2))
    return scored.select("table", "score", recommendation(F.col("score")).alias("recommendation"))


def recommendation(score: Column) -> Column:
    return F.when(score >= 70, "migrate").when(score >= 40, "review").otherwise("archive")


def baseline(tables: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """table, column_name, row_count, null_percent, distinct_count of the given columns, to be stored."""
    from migcheck.operators.profile import column_profile

    out = None
    for name, (df, columns) in tables.items():
        part = column_profile(df, columns).select(F.lit(name).alias("table"), "column_name", "row_count", "null_percent", "distinct_count")
        out = part if out is None else out.union(part)
    return out
