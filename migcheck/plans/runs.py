"""Run history: latest runs, lifecycle averages, rollups over metadata tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest_runs(runs: DataFrame) -> DataFrame:
    """The newest run of each dataset and phase."""
    order = W.partitionBy("dataset", "phase").orderBy(F.desc("run_id"))
    return runs.withColumn("at", F.row_number().over(order)).where("at = 1").drop("at")


def run_status(runs: DataFrame, n: int = 10) -> DataFrame:
    return runs.orderBy(F.desc("run_id")).limit(n)


def lifecycle_score(runs: DataFrame) -> DataFrame:
    """Mean score above 0 of the latest date, and the mean of all pre and of all non-zero post scores."""
    last = runs.agg(F.max("run_date").alias("latest"))  # one row
    score = F.col("score")
    return runs.join(F.broadcast(last)).agg(
        F.round(F.avg(F.when((F.col("run_date") == F.col("latest")) & (score > 0), score)), 2).alias("latest_mean"),
        F.round(F.avg(F.when(F.col("phase") == "pre", score)), 2).alias("pre_mean"),
        F.round(F.avg(F.when((F.col("phase") == "post") & (score > 0), score)), 2).alias("post_mean"),
    )


def count_by(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias("n"))


def pii_handling(glossary: DataFrame, mappings: DataFrame) -> DataFrame:
    """Per table: personal columns, how many are archived or transformed, whether all are."""
    treated = mappings.where("type IN ('archived', 'transform')").select("table", F.col("source").alias("name"), F.lit(True).alias("handled")).distinct()
    own = glossary.where("pii").join(treated, ["table", "name"], "left").withColumn("handled", F.coalesce("handled", F.lit(False)))
    return own.groupBy("table").agg(F.count("*").alias("n_pii"), F.count_if("handled").alias("n_handled"), F.every("handled").alias("all_handled"))


def detection_methods(glossary: DataFrame, tags: DataFrame) -> DataFrame:
    """(table, name, method) of the personal columns: their tags in order, else that a keyword matched."""
    tagged = tags.groupBy("table", "name").agg(F.array_join(F.array_sort(F.collect_set("tag")), ", ").alias("method"))  # tags of one column
    return glossary.where("pii").join(tagged, ["table", "name"], "left").select("table", "name", F.coalesce("method", F.lit("keyword match")).alias("method"))


def signoff_gate(runs: DataFrame, signoffs: DataFrame) -> DataFrame:
    """(dataset, may_run_post): a dataset's post phase waits for an approved sign-off of its pre phase."""
    approved = signoffs.where("phase = 'pre' AND approved").select("dataset", F.lit(True).alias("signed")).distinct()
    return runs.select("dataset").distinct().join(approved, "dataset", "left").select("dataset", F.coalesce("signed", F.lit(False)).alias("may_run_post"))


def read_signoffs(lines: DataFrame) -> DataFrame:
    """signed_on, dataset, phase, who, approved from lines of five parts with bars between them."""
    part = F.split("line", r"\|")
    return lines.select(part[0].alias("signed_on"), part[1].alias("dataset"), part[2].alias("phase"), part[3].alias("who"), (part[4] == "approved").alias("approved"))


def append_signoff(spark: SparkSession, path: str, signed_on: str, dataset: str, phase: str, who: str, approved: bool) -> None:
    """Add a line to the sign-off log; bars in a part become blanks."""
    parts = [str(p).replace("|", " ") for p in (signed_on, dataset, phase, who)] + ["approved" if approved else "rejected"]
    spark.createDataFrame([("|".join(parts),)], "line string").write.mode("append").text(path)


def compliance_checklist(pii: DataFrame, naming_violations: DataFrame, statuses: DataFrame, runs: DataFrame, generated: DataFrame) -> DataFrame:
    """(check, passed), one row each, and a last one for all of them; ``generated`` has the lines of the generated schema."""
    checks = (
        pii.agg(F.coalesce(F.every("all_handled"), F.lit(True)).alias("passed")).select(F.lit("pii_handled").alias("check"), "passed")
        .union(naming_violations.agg((F.count("*") == 0).alias("passed")).select(F.lit("naming"), "passed"))
        .union(statuses.agg((F.count_if(F.col("status") == "VIOLATION") == 0).alias("passed")).select(F.lit("no_violations"), "passed"))
        .union(runs.where("phase = 'pre'").agg(F.coalesce(F.min("score") >= 70, F.lit(False)).alias("passed")).select(F.lit("pre_at_least_70"), "passed"))
        .union(runs.where("phase = 'post'").agg(F.coalesce(F.min("score") >= 90, F.lit(False)).alias("passed")).select(F.lit("post_at_least_90"), "passed"))
        .union(generated.agg((F.count("*") > 0).alias("passed")).select(F.lit("schema_generated"), "passed"))
    )
    return checks.union(checks.agg(F.every("passed").alias("passed")).select(F.lit("all_passed"), "passed"))


def field_io(uses: DataFrame) -> DataFrame:
    """Fields of a program as input (only read), output (only written) or working (both)."""
    modes = uses.groupBy("program", "field").agg(F.bool_or(F.col("mode") == "r").alias("read"), F.bool_or(F.col("mode") == "w").alias("written"))
    kind = F.when(F.col("read") & F.col("written"), "working").when(F.col("read"), "input").otherwise("output")
    return modes.select("program", "field", kind.alias("kind"))
