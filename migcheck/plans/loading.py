"""Dependency-ordered loading."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from migcheck.operators.keys import orphan_rows


def load_order(edges: DataFrame, tables: DataFrame, most_levels: int = 50) -> DataFrame:
    """table and level: a table loads one level after the last of its parents; a cycle is an error.

    ``edges`` (child, parent) hold one row for each foreign key of a schema.
    """
    levels = tables.select("table", F.lit(0).alias("level"))
    for _ in range(most_levels):
        above = edges.join(levels.withColumnRenamed("table", "parent"), "parent").groupBy("child").agg((F.max("level") + 1).alias("above"))
        raised = levels.join(above, levels["table"] == above["child"], "left").select("table", F.greatest("level", F.coalesce("above", F.lit(0))).alias("level"))
        rows = [tuple(r) for r in raised.collect()]  # tables of a schema
        if sorted(rows) == sorted(tuple(r) for r in levels.collect()):
            return levels
        levels = tables.sparkSession.createDataFrame(rows, "table string, level int")
    raise ValueError("the foreign keys form a cycle")


def normalization_integrity(flat: DataFrame, primary: DataFrame, children: list[tuple[DataFrame, str, str]]) -> DataFrame:
    """n_flat, n_primary, n_empty_children, n_orphans of a normalised set, with penalty (30 at most) and status."""
    counts = flat.agg(F.count("*").alias("n_flat")).join(F.broadcast(primary.agg(F.count("*").alias("n_primary"))))  # one row each
    empty = orphans = None
    for rows, foreign, own in children:
        bare = rows.agg((F.count("*") == 0).cast("long").alias("n"))
        lost = orphan_rows(rows, foreign, primary, own).agg(F.count("*").alias("n"))
        empty = bare if empty is None else empty.union(bare)
        orphans = lost if orphans is None else orphans.union(lost)
    lost = orphans.agg(F.sum("n").alias("n_orphans"), F.count_if(F.col("n") > 0).alias("n_orphaned_children"))
    counts = counts.join(F.broadcast(empty.agg(F.sum("n").alias("n_empty_children")))).join(F.broadcast(lost))
    # each child with orphans is a finding of its own
    high = (F.col("n_flat") != F.col("n_primary")).cast("int") + F.col("n_orphaned_children")
    penalty = F.least(F.lit(30), 5 * high + 2 * F.col("n_empty_children")).cast("long")
    return counts.withColumn("penalty", penalty).drop("n_orphaned_children").withColumn(
        "status", F.when(F.col("penalty") == 0, "PASS").when(F.col("penalty") >= 10, "FAIL").otherwise("WARN")
    )


def run_loads(steps: list[tuple[str, DataFrame, str]], done: set[str]) -> dict[str, str]:
    """Load (table, frame, path) in order, without those in ``done``; a failure is noted and does not stop the others."""
    from migcheck.sources.tables import full_load

    state = {name: "completed" for name in done}
    for name, frame, path in steps:
        if name not in done:
            try:
                state[name] = f"completed: {full_load(frame, path)} rows"
            except Exception as error:  # noqa: BLE001 - the state table carries the reason
                state[name] = f"failed: {str(error)[:200]}"
    return state


STATE = "table string, status string, rows long, error string, at timestamp"


def load_state(spark: SparkSession, path: str) -> DataFrame:
    """The latest state of each table (none where nothing was written yet)."""
    from pyspark.errors import AnalysisException

    try:
        rows = spark.read.schema(STATE).json(path)
    except AnalysisException:  # no state was written yet
        rows = spark.createDataFrame([], STATE)
    last = W.partitionBy("table").orderBy(F.desc("at"), "status")
    return rows.withColumn("nth", F.row_number().over(last)).where("nth = 1").drop("nth")


def resume_loads(steps: list[tuple[str, DataFrame, str]], path: str) -> dict[str, str]:
    """Load (table, frame, path) in order, without those that the state below ``path`` calls completed; each step is noted there.

    A failure is noted and does not stop the others; the next call tries it again.
    """
    from migcheck.sources.tables import full_load

    if not steps:
        return {}
    spark = steps[0][1].sparkSession
    out = {r["table"]: "completed" for r in load_state(spark, path).where("status = 'completed'").collect()}  # tables of a schema
    for name, frame, target in steps:
        if name in out:
            continue
        try:
            row = (name, "completed", full_load(frame, target), None)
        except Exception as error:  # noqa: BLE001 - the state carries the reason
            row = (name, "failed", None, str(error)[:200])
        spark.createDataFrame([row], "table string, status string, rows long, error string").withColumn("at", F.current_timestamp()).write.mode("append").json(path)
        out[name] = row[1]
    return out
