"""Confidence scores as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Weights of structure, integrity and governance.
WEIGHTS = {"structure": 0.4, "integrity": 0.4, "governance": 0.2}

# Points that a target platform takes off structure, integrity and governance.
PENALTIES = (
    ("postgres", 0, 0, 0),
    ("snowflake", 2, 5, 4),
    ("oracle", 3, 0, 0),
    ("redshift", 3, 8, 4),
    ("sqlserver", 1, 0, 0),
    ("azuresql", 1, 0, 0),
)


def traffic_light(score: Column, green: float = 90, yellow: float = 70) -> Column:
    return F.when(score >= green, "GREEN").when(score >= yellow, "YELLOW").otherwise("RED")


def penalties(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PENALTIES, "target string, structure_penalty int, integrity_penalty int, governance_penalty int")


def confidence(scores: DataFrame) -> DataFrame:
    """Each row of component scores against every target platform: score and light."""
    table = F.broadcast(penalties(scores.sparkSession))  # six rows
    parts = (F.greatest(F.lit(0), F.col(k) - F.col(f"{k}_penalty")) * F.lit(w) for k, w in WEIGHTS.items())
    score = F.round(reduce(lambda a, b: a + b, parts), 2)
    return scores.join(table).withColumn("score", score).withColumn("light", traffic_light(F.col("score")))


def score_rollup(results: DataFrame) -> DataFrame:
    """dataset, phase, n_findings, total_penalty, score (100 less penalties, at least 0) and light."""
    score = F.greatest(F.lit(0.0), 100 - F.sum("penalty"))
    found = results.groupBy("dataset", "phase").agg(
        F.count_if(F.col("status") != "PASS").alias("n_findings"), F.round(F.sum("penalty"), 2).alias("total_penalty"), F.round(score, 2).alias("score")
    )
    return found.withColumn("light", traffic_light(F.col("score")))


def reweighted(structure: Column, governance: Column) -> Column:
    """The pre-phase score without the integrity that cannot be known yet."""
    return F.round(structure * 0.67 + governance * 0.33, 2)


def proof_score(latest: DataFrame) -> DataFrame:
    """dataset, score: the mean of the latest pre and post scores; INCOMPLETE without either."""
    both = latest.groupBy("dataset").agg(
        F.max(F.when(F.col("phase") == "pre", F.col("score"))).alias("pre"), F.max(F.when(F.col("phase") == "post", F.col("score"))).alias("post")
    )
    mean = (F.col("pre") + F.col("post")) / 2
    return both.select("dataset", F.round(mean, 2).alias("score"), F.when(mean.isNull(), "INCOMPLETE").otherwise(traffic_light(mean)).alias("status"))
