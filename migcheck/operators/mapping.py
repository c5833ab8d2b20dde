"""Column mappings and glossaries built from schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from migcheck.functions.names import clean_name, described, expand, is_personal, suffix
from migcheck.operators.matching import match_columns

# Parts of personal columns' names whose data is archived, and suffixes that mean bank data.
ARCHIVED = "eft|bank"
BANK = ("bact", "brtn", "bacct", "broute", "bkact", "bkrtn")


def glossary(schema: DataFrame, system: str = "legacy") -> DataFrame:
    """table, name, system, description, data_type, pii, confidence of each (table, source, data_type)."""
    text, sure = described(F.col("source"), F.col("data_type"))
    return schema.select(
        "table", F.col("source").alias("name"), F.lit(system).alias("system"), text.alias("description"), "data_type", is_personal(F.col("source")).alias("pii"), sure.alias("confidence")
    )


def build_mappings(legacy: DataFrame, modern: DataFrame, overrides: DataFrame, threshold: float = 0.7) -> DataFrame:
    """table, source, target, type, confidence of every legacy column.

    A stated override (table, source, target, type) comes first; fillers are removed and bank data archived;
    then the matcher's target; a social security number without one becomes a hash; the rest is pending.
    """
    own = overrides.select("table", "source", F.col("target").alias("own_target"), F.col("type").alias("own_type"))
    matched = match_columns(legacy, modern, threshold).withColumnsRenamed({"target": "found", "confidence": "sure"})
    joined = legacy.select("table", "source").join(own, ["table", "source"], "left").join(matched, ["table", "source"], "left")
    name, wide = clean_name(F.col("source")), expand(F.col("source"))
    secret = F.contains(name, F.lit("ssn"))
    bank = wide.isin("bank_account", "bank_routing") | suffix(F.col("source")).isin(*BANK) | (is_personal(name) & name.rlike(ARCHIVED))
    kind = (
        F.when(F.col("own_type").isNotNull(), F.col("own_type"))
        .when(wide == "_filler", "removed")
        .when(bank, "archived")
        .when(secret, "transform")
        .when(F.col("found").isNotNull(), "rename")
        .otherwise("pending")
    )
    hashed = F.when(wide.endswith("_hash"), wide).otherwise(F.concat(wide, F.lit("_hash")))
    target = F.when(F.col("own_type").isNotNull(), F.col("own_target")).when(kind == "transform", hashed).when(kind == "rename", F.col("found"))
    confidence = F.when(F.col("own_type").isNotNull(), 1.0).when(kind.isin("removed", "archived", "transform"), 0.9).otherwise(F.coalesce("sure", F.lit(0.0)))
    return joined.select("table", "source", target.alias("target"), kind.alias("type"), confidence.alias("confidence"))


def set_target(mappings: DataFrame, changes: DataFrame) -> DataFrame:
    """Mappings with the targets that ``changes`` (table, source, target) state; only those rows become manual (confidence 1)."""
    new = changes.select("table", "source", F.col("target").alias("new_target"))
    joined = mappings.join(new, ["table", "source"], "left")
    changed = F.col("new_target").isNotNull() & ~F.col("new_target").eqNullSafe(F.col("target"))
    return joined.select(
        "table", "source", F.when(changed, F.col("new_target")).otherwise(F.col("target")).alias("target"), "type", F.when(changed, 1.0).otherwise(F.col("confidence")).alias("confidence")
    )
