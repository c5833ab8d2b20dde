"""Comparison of schemas, as DataFrames of (column_name, data_type)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def type_name(kind: T.DataType) -> str:
    """The SQL name by which types are compared."""
    names = {
        T.StringType: "varchar", T.ShortType: "smallint", T.IntegerType: "integer", T.LongType: "bigint", T.FloatType: "real",
        T.DoubleType: "double", T.BooleanType: "boolean", T.DateType: "date", T.TimestampType: "timestamptz",
        T.TimestampNTZType: "timestamp", T.BinaryType: "bytea",
    }
    return f"numeric({kind.precision},{kind.scale})" if isinstance(kind, T.DecimalType) else names.get(type(kind), kind.simpleString())


def schema_of(spark: SparkSession, df: DataFrame) -> DataFrame:
    """(column_name, data_type, position) of a DataFrame."""
    rows = [(f.name, type_name(f.dataType), i) for i, f in enumerate(df.schema.fields)]
    return spark.createDataFrame(rows, "column_name string, data_type string, position int")


def schema_diff(legacy: DataFrame, modern: DataFrame) -> DataFrame:
    """column_name, both types and the change: missing_in_modern, missing_in_legacy, type_mismatch or same."""
    left = legacy.select("column_name", F.col("data_type").alias("legacy_type"))
    right = modern.select("column_name", F.col("data_type").alias("modern_type"))
    change = (
        F.when(F.col("modern_type").isNull(), "missing_in_modern")
        .when(F.col("legacy_type").isNull(), "missing_in_legacy")
        .when(F.col("legacy_type") != F.col("modern_type"), "type_mismatch")
        .otherwise("same")
    )
    return left.join(right, "column_name", "full_outer").withColumn("change", change)


def schema_penalty(diff: DataFrame, mappings: DataFrame) -> DataFrame:
    """Penalty and status: 4 for each column lost without a reason, 1 for archived, 5 for each type mismatch."""
    known = mappings.select(F.col("source").alias("column_name"), "type")
    found = diff.join(known, "column_name", "left")
    lost = F.when(F.col("type").isin("rename", "transform"), 0).when(F.col("type") == "archived", 1).otherwise(4)
    points = F.when(F.col("change") == "missing_in_modern", lost).when(F.col("change") == "type_mismatch", 5).otherwise(0)
    total = found.agg(F.sum(points).cast("long").alias("penalty"))
    return total.withColumn("status", F.when(F.col("penalty") == 0, "PASS").when(F.col("penalty") < 20, "WARN").otherwise("FAIL"))


def schema_drift(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """column_name and change against a baseline: added, dropped or type_changed; no rows without drift."""
    renamed = {"missing_in_modern": "dropped", "missing_in_legacy": "added", "type_mismatch": "type_changed"}
    names = F.create_map(*(F.lit(x) for pair in renamed.items() for x in pair))
    diff = schema_diff(baseline, current).where("change <> 'same'")
    return diff.select("column_name", F.col("legacy_type").alias("baseline_type"), F.col("modern_type").alias("current_type"), names[F.col("change")].alias("change"))


def unmapped_columns(modern: DataFrame, mappings: DataFrame) -> DataFrame:
    """Modern columns that no mapping names as its target."""
    return modern.join(mappings.where("target IS NOT NULL").select(F.col("target").alias("column_name")), "column_name", "left_anti").select("column_name")


def archived_leakage(modern: DataFrame, mappings: DataFrame) -> DataFrame:
    """Archived columns that are in the modern table, under either name."""
    gone = mappings.where("type = 'archived'")
    names = gone.select(F.col("source").alias("column_name")).union(gone.select("target")).where("column_name IS NOT NULL")
    return modern.join(names, "column_name", "left_semi").select("column_name")


def column_pairs(legacy: DataFrame, modern: DataFrame, mappings: DataFrame) -> DataFrame:
    """(source, target) to compare: mapped columns on both sides, and unmapped ones of the same name."""
    compared = mappings.where("type NOT IN ('removed', 'transform', 'archived') AND target IS NOT NULL").select("source", "target")
    left, right = legacy.select(F.col("column_name").alias("source")), modern.select(F.col("column_name").alias("target"))
    mapped = compared.join(left, "source", "left_semi").join(right, "target", "left_semi").select("source", "target")
    free = left.join(mappings.select("source"), "source", "left_anti")
    same = free.join(right, free["source"] == right["target"]).select("source", "target")
    return mapped.union(same)


def apply_mapping(plan: DataFrame, mappings: DataFrame) -> DataFrame:
    """Modern name of each (table, column): the table's mapping, else one for the name alone, else the name."""
    exact = mappings.where("table IS NOT NULL").select("table", F.col("source").alias("column"), F.col("target").alias("exact"))
    loose = mappings.where("table IS NULL").select(F.col("source").alias("column"), F.col("target").alias("loose"))
    joined = plan.join(exact, ["table", "column"], "left").join(loose, "column", "left")
    return joined.select("table", "column", F.coalesce("exact", "loose", "column").alias("modern"))
