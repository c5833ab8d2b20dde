"""Checks of transform scripts against the mappings they should carry out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Texts that mean yes or no.
YES_NO = ("Y", "N", "YES", "NO", "T", "F", "TRUE", "FALSE")


def boolean_columns(df: DataFrame) -> DataFrame:
    """column_name of the columns whose values all mean yes or no, in one pass; nulls do not count, no rows give none."""
    cells = df.agg(*((F.coalesce(F.every(F.upper(F.col(c).cast("string")).isin(*YES_NO)), F.lit(True)) & (F.count("*") > 0)).alias(c) for c in df.columns))
    return cells.unpivot([], df.columns, "column_name", "fits").where("fits").select("column_name")


def transform_issues(scripts: DataFrame, mappings: DataFrame, booleans: DataFrame) -> DataFrame:
    """(table, test, severity, subject) of what the scripts (table, script) lack or should not hold.

    ``mappings`` has table, source, target, type and rationale; ``booleans`` (table, column_name) lists columns of
    yes and no.  A table without a script has no issues; names are looked for as plain text.
    """
    joined = mappings.join(scripts, "table")
    script, kind, named = F.col("script"), F.col("type"), F.coalesce(F.col("target") != "", F.lit(False))
    hashed = F.lower("rationale").rlike("sha|hash") & ~F.lower(script).rlike("sha256|encode")

    def issue(condition, test: str, severity: str):
        return F.when(condition, F.struct(F.lit(test).alias("test"), F.lit(severity).alias("severity")))

    found = F.array(
        issue(kind.isin("archived", "removed") & named & F.contains(script, F.col("target")), "archived_column_in_transform", "HIGH"),
        issue((kind == "transform") & named & ~F.contains(script, F.col("source")), "transform_source_missing", "MEDIUM"),
        issue((kind == "transform") & hashed, "pii_hash_missing", "HIGH"),
    )
    of_mappings = joined.select("table", "source", F.explode(F.array_compact(found)).alias("x")).select("table", "x.test", "x.severity", F.col("source").alias("subject"))
    empty = scripts.where(F.trim("script") == "").select("table", F.lit("transform_not_empty").alias("test"), F.lit("HIGH").alias("severity"), F.col("table").alias("subject"))
    unconverted = booleans.join(scripts, "table").where(~F.upper(script).rlike("CASE WHEN|BOOLEAN"))
    return empty.union(of_mappings).union(unconverted.select("table", F.lit("boolean_conversion_missing"), F.lit("LOW"), "column_name"))


def transform_penalty(issues: DataFrame) -> DataFrame:
    """n_issues, penalty (3 for each HIGH and 1 for each MEDIUM issue, 20 at most) and status."""
    points = F.when(F.col("severity") == "HIGH", 3).when(F.col("severity") == "MEDIUM", 1).otherwise(0)
    total = issues.agg(F.count("*").alias("n_issues"), F.least(F.lit(20), F.coalesce(F.sum(points), F.lit(0))).cast("long").alias("penalty"))
    return total.withColumn("status", F.when(F.col("n_issues") == 0, "PASS").when(F.col("penalty") >= 10, "FAIL").otherwise("WARN"))
