"""Observation of loaded tables against a stored baseline."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from migcheck.operators import sketches
from migcheck.operators.keys import orphan_keys
from migcheck.operators.profile import column_profile
from migcheck.operators.schema import schema_drift, schema_of
from migcheck.plans.monitor import volume_anomaly
from migcheck.sources.discovery import append_alerts

#: Columns that tell when a row was changed, the first one present counts.
CHANGED_AT = ("updated_at", "created_at")

# How grave a finding of each check is.
SEVERITY = {"schema_drift": "HIGH", "volume_anomaly": "MEDIUM", "freshness": "MEDIUM", "fk_integrity": "HIGH"}


def snapshot(tables: dict[str, DataFrame]) -> DataFrame:
    """table, column_name, data_type, row_count, null_percent, distinct_count of every column."""

    def one(name: str, df: DataFrame) -> DataFrame:
        kinds = schema_of(df.sparkSession, df).select("column_name", "data_type")
        counts = df.agg(F.count("*").alias("row_count"))  # one row
        found = column_profile(df).select("column_name", "null_percent", "distinct_count")
        return kinds.join(F.broadcast(counts)).join(found, "column_name", "left").select(F.lit(name).alias("table"), "column_name", "data_type", "row_count", "null_percent", "distinct_count")

    return reduce(DataFrame.union, (one(name, df) for name, df in tables.items()))


def save_baseline(tables: dict[str, DataFrame], path: str) -> None:
    snapshot(tables).coalesce(1).write.mode("overwrite").parquet(path)  # a row a column


def load_baseline(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_sketches(tables: dict[str, DataFrame], path: str) -> None:
    """Sketches of every column, beside a baseline: later ones are held against them without a look at the former rows."""
    for name, df in tables.items():
        sketches.column_sketches(df).coalesce(1).write.mode("overwrite").parquet(f"{path}/table={name}")  # a row a column


def distribution_drift(tables: dict[str, DataFrame], path: str, distinct: float = 0.1, rank: float = 0.05) -> DataFrame:
    """Findings of columns whose distinct counts or medians moved from the sketches below ``path`` (see :func:`migcheck.operators.sketches.drift`)."""

    def one(name: str, df: DataFrame) -> DataFrame:
        before = df.sparkSession.read.parquet(f"{path}/table={name}")
        found = sketches.drift(before, sketches.column_sketches(df), distinct, rank)
        return _finding("distribution_drift", name, found, F.lit(True), F.concat_ws(":", "change", "column_name", "detail"))

    return reduce(DataFrame.union, (one(name, df) for name, df in tables.items()))


def _finding(check: str, table: str, rows: DataFrame, alert: Column, detail: Column) -> DataFrame:
    return rows.select(F.lit(check).alias("check"), F.lit(table).alias("table"), F.lit(SEVERITY.get(check, "MEDIUM")).alias("severity"), alert.alias("alert"), detail.cast("string").alias("detail"))


def observe(
    tables: dict[str, DataFrame],
    baseline: DataFrame,
    now: str,
    most_hours: float = 24,
    threshold: float = 0.3,
    references: dict[str, list[tuple[str, DataFrame, str]]] | None = None,
    checks: tuple[str, ...] = tuple(SEVERITY),
) -> DataFrame:
    """check, table, severity, alert, detail: schema drift, volume, freshness and foreign keys of every table.

    ``references`` maps a table to (column, parent, parent's column); ``checks`` are those to make.  A table without a column that tells
    when rows changed is not stale; one without rows is.
    """
    out = []
    for name, df in tables.items():
        own = baseline.where(F.col("table") == name)
        drift = schema_drift(own.select("column_name", "data_type"), schema_of(df.sparkSession, df))
        drift = drift.agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "change", "column_name"))), ",").alias("found"))  # columns of one table
        out.append(_finding("schema_drift", name, drift, F.col("found") != "", F.col("found")))
        counts = df.agg(F.count("*").alias("n")).join(F.broadcast(own.agg(F.max("row_count").alias("base"))))  # one row each
        deviation, anomaly = volume_anomaly(F.col("n"), F.coalesce("base", F.lit(0)))
        out.append(_finding("volume_anomaly", name, counts, F.coalesce(deviation > threshold * 100, anomaly), deviation))
        changed = next((c for c in CHANGED_AT if c in df.columns), None)
        if changed:
            latest = df.agg(F.max(changed).alias("latest"))
            hours = (F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(F.col("latest").cast("timestamp"))) / 3600
            out.append(_finding("freshness", name, latest, F.coalesce(hours > most_hours, F.lit(True)), F.round(hours, 2)))
        else:
            one = df.sparkSession.range(1)
            out.append(_finding("freshness", name, one, F.lit(False), F.lit("no column tells when rows changed")))
        for column, parent, key in (references or {}).get(name, []):
            lost = orphan_keys(df, column, parent, key).agg(F.count("*").alias("n"))
            out.append(_finding("fk_integrity", name, lost, F.col("n") > 0, F.concat_ws(":", F.lit(column), "n")))
    return reduce(DataFrame.union, out).where(F.col("check").isin(*checks))


def dispatch(findings: DataFrame, path: str, callbacks: list[Callable] = (), mode: str = "append") -> int:
    """Write the alerts among ``findings`` as JSON lines and hand each to the callbacks; how many there were.

    Findings are a few rows a table, so they may be collected.
    """
    alerts = findings.where("alert")
    rows = [r.asDict() for r in alerts.collect()]
    if rows:
        append_alerts(findings.sparkSession.createDataFrame(rows, findings.schema), path, mode)
    for row in rows:
        for callback in callbacks:
            callback(row["check"], row)
    return len(rows)
