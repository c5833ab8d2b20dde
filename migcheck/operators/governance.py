"""Rules on names, nulls, encodings and personal data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from migcheck.functions.names import is_personal
from migcheck.operators.profile import null_percentages

NAMING = r"^[a-z][a-z0-9_]*$"

# Signs of text that was decoded with the wrong encoding, by kind.
DAMAGE = {
    "mojibake": "(?:Ã[\u0080-¿])|(?:â\u0080[\u0090-¿])|(?:ï¿½)",
    "nul_byte": r"\x00",
    "replacement": "�",
}


def pii_columns(schema: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    return schema.where(is_personal(F.col("column_name"), more)).select("column_name")


def naming_violations(schema: DataFrame, pattern: str = NAMING) -> DataFrame:
    return schema.where(~F.col("column_name").rlike(pattern)).select("column_name")


def null_violations(df: DataFrame, most: float) -> DataFrame:
    """Columns whose null percentage exceeds ``most``."""
    return null_percentages(df).where(F.col("null_percent") > most).select("column_name", F.round("null_percent", 2).alias("null_percent"))


def governance_score(unhandled: Column, handled: Column, naming: Column, missing: Column, nulls: Column) -> Column:
    """100 less capped points for personal data, names, missing fields and nulls."""
    capped = lambda n, each, most: F.least(n * each, F.lit(most))
    lost = capped(unhandled, 5, 30) + capped(handled, 1, 10) + capped(naming, 2, 10) + capped(missing, 10, 30) + capped(nulls, 3, 15)
    return (100 - lost).cast("long")


def governance(df: DataFrame, schema: DataFrame, handled: DataFrame, required: list[str], most_null: float, pattern: str = NAMING) -> DataFrame:
    """Counts of all findings with the score; ``handled`` lists personal columns that are archived or hashed."""
    personal = pii_columns(schema)
    counted = {
        "unhandled": personal.join(handled, "column_name", "left_anti"),
        "handled": personal.join(handled, "column_name", "left_semi"),
        "naming": naming_violations(schema, pattern),
        "nulls": null_violations(df, most_null),
    }
    have = {f.name.lower() for f in df.schema.fields}
    missing = sum(name.lower() not in have for name in required)
    findings = None
    for kind, rows in counted.items():
        part = rows.select(F.lit(kind).alias("kind"))
        findings = part if findings is None else findings.union(part)
    total = findings.agg(*(F.count_if(F.col("kind") == k).alias(k) for k in counted)).withColumn("missing", F.lit(missing).cast("long"))
    score = governance_score(*(F.col(c) for c in ("unhandled", "handled", "naming", "missing", "nulls")))
    return total.withColumn("score", score).withColumn("status", F.when(F.col("score") == 100, "PASS").otherwise("WARN"))


def encoding_issues(df: DataFrame, columns: list[str]) -> DataFrame:
    """column_name, kind, n of damaged texts, in one pass over all columns and rows."""
    cells = [F.count_if(F.col(c).rlike(p)).alias(f"{c}\t{k}") for c in columns for k, p in DAMAGE.items()]
    names = [f"{c}\t{k}" for c in columns for k in DAMAGE]
    found = df.agg(*cells).unpivot([], names, "name", "n").where("n > 0")
    parts = F.split("name", "\t")
    return found.select(parts[0].alias("column_name"), parts[1].alias("kind"), "n")


def broken_rules(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """(rule, n): how many rows meet each SQL predicate that should never hold."""
    counts = df.agg(*(F.count_if(F.expr(p)).alias(k) for k, p in rules.items()))
    return counts.unpivot([], list(rules), "rule", "n")


def schema_failures(df: DataFrame, types: dict[str, str], required: list[str], unique: list[str]) -> DataFrame:
    """(check, column_name, n): values that do not cast, nulls in required columns, repeated values in unique ones."""
    bad = {
        **{("type", c): F.count_if(F.col(c).isNotNull() & F.col(c).cast("string").try_cast(t).isNull()) for c, t in types.items()},
        **{("not_null", c): F.count_if(F.col(c).isNull()) for c in required},
    }
    names = [f"{a}\t{b}" for a, b in bad]
    parts = F.split("name", "\t")
    cells = df.agg(*(v.cast("long").alias(f"{a}\t{b}") for (a, b), v in bad.items())).unpivot([], names, "name", "n")
    out = cells.select(parts[0].alias("check"), parts[1].alias("column_name"), "n")
    for c in unique:
        again = df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("rows")).agg(F.coalesce(F.sum(F.when(F.col("rows") > 1, F.col("rows"))), F.lit(0)).alias("n"))
        out = out.union(again.select(F.lit("unique").alias("check"), F.lit(c).alias("column_name"), "n"))
    return out
