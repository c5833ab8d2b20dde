"""Best-match operators over small name lists and length bands."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from migcheck.functions.names import expand, suffix, word_overlap


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity of two names; it has no built-in form."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype=float)


def match_columns(sources: DataFrame, targets: DataFrame, threshold: float = 0.7) -> DataFrame:
    """source, target, confidence: the best target of each (table, source), if one is close enough.

    Names are paired inside a table only; a table has tens of columns, so the pairs stay few.
    Fillers and bank data are not matched.
    """
    pairs = sources.join(targets, "table")
    low, other = F.lower("source"), F.lower("target")
    wide = expand(F.col("source"))
    singular = F.regexp_replace(F.lower("table"), "s$", "")
    last = F.element_at(F.split(singular, "_"), -1)
    record = wide == "_record_id"
    contains = F.contains(other, wide) | F.contains(wide, other)
    fuzzy = F.greatest(similarity(low, other), similarity(wide, other))
    score = (
        F.when(low == other, 1.0)
        .when(record & (other == F.concat(singular, F.lit("_id"))), 0.951)
        .when(record & (other == F.concat(last, F.lit("_id"))), 0.95)
        .when(record, F.when(other.endswith("_id"), 0.85))
        .when(wide == other, 0.95)
        .when((wide != low) & contains, F.least(F.length(wide) / F.length(other), F.lit(0.92)))
        .when((wide != low) & (word_overlap(wide, other) >= 0.8), 0.9)
        .when(fuzzy >= threshold, F.least(fuzzy, F.lit(0.7)) * 0.5)
    )
    hidden = (wide == "_filler") | wide.isin("bank_account", "bank_routing") | suffix(F.col("source")).isin("bacct", "broute", "bkact", "bkrtn")
    scored = pairs.where(~hidden).withColumns({"rank": score, "fuzzy": fuzzy}).where("rank IS NOT NULL")
    best = W.partitionBy("table", "source").orderBy(F.desc("rank"), F.desc("fuzzy"), "target")
    confidence = F.when(F.col("rank") <= 0.35, F.col("fuzzy")).otherwise(F.col("rank"))
    top = scored.withColumn("at", F.row_number().over(best)).where("at = 1")
    return top.select("table", "source", "target", F.round(confidence, 2).alias("confidence"))


def pair_by_length(files: DataFrame, layouts: DataFrame, band: int = 2) -> DataFrame:
    """The closest layout of each file whose record length differs by at most ``band``.

    The band join is an equi join: each file goes to the 2 * band + 1 lengths that it may meet.
    """
    near = files.withColumn("record_length", F.explode(F.sequence(F.col("line_length") - band, F.col("line_length") + band)))
    met = near.join(layouts, "record_length").withColumn("gap", F.abs(F.col("line_length") - F.col("record_length")))
    order = W.partitionBy("file").orderBy("gap", "layout")
    return met.withColumn("at", F.row_number().over(order)).where("at = 1").select("file", "layout", F.col("gap").cast("int").alias("gap"))
