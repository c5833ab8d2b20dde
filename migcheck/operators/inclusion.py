"""Inclusion dependencies: which columns' values are all, or nearly all, values of another column.

All columns of all tables are looked at in one pass.  Every value is tagged with its column as one bit of
a mask; the values are grouped once, which unites the masks (before the shuffle already), and what is left
is counted by mask.  A pair of columns shares the values of all masks with both bits, so pairs are only
formed from the few different masks, never from rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bits used of one mask; further columns go to further masks.
BITS = 60

#: Longer texts meet as their SHA-256.
LONGEST = 64


def kind_of(data_type: T.DataType) -> str | None:
    """Only values of one kind can refer to each other; other types take no part."""
    if isinstance(data_type, T.IntegralType):
        return "whole"
    if isinstance(data_type, (T.FractionalType, T.DecimalType)):
        return "number"
    if isinstance(data_type, T.StringType):
        return "text"
    if isinstance(data_type, T.DateType):
        return "day"
    return "time" if isinstance(data_type, (T.TimestampType, T.TimestampNTZType)) else None


def cell(name: str, kind: str, as_written: bool = False) -> Column:
    if kind == "number":
        return (F.col(name) if as_written else F.col(name) + F.lit(0)).cast("double").cast("string")
    if kind == "text":
        return F.when(F.length(name) > LONGEST, F.sha2(name, 256)).otherwise(F.col(name))
    return F.col(name).cast("string")


def inclusions(tables: dict[str, DataFrame], as_written: bool = False) -> DataFrame:
    """child_table, child_column, parent_table, parent_column, n_values, n_shared, coverage, parent_unique of all pairs that share a value.

    ``n_values`` are the child's distinct values, nulls aside, ``n_shared`` those of them that the parent
    has too; ``parent_unique`` tells that no value of the parent repeats.  Pairs are within and between tables.
    With ``as_written`` numbers meet by their texts, as they do in SQL over texts: -0.0 is then another value than 0.0.
    """
    columns = [(table, f.name, kind) for table, df in tables.items() for f in df.schema.fields if (kind := kind_of(f.dataType))]
    spark = next(iter(tables.values())).sparkSession
    words = [f"mask{w}" for w in range(-(-len(columns) // BITS))]

    def bits(i: int) -> list[int]:
        return [1 << i % BITS if i // BITS == w else 0 for w in range(len(words))]

    def tagged(table: str, df: DataFrame) -> DataFrame:
        cells = [
            F.struct(F.lit(kind).alias("kind"), cell(name, kind, as_written).alias("value"), *(F.lit(b).cast("long").alias(w) for w, b in zip(words, bits(i))))
            for i, (owner, name, kind) in enumerate(columns)
            if owner == table
        ]
        return df.select(F.explode(F.array(*cells)).alias("c")).select("c.*").where("value IS NOT NULL")

    values = reduce(DataFrame.union, (tagged(t, df) for t, df in tables.items() if any(owner == t for owner, _, _ in columns)))
    masks = values.groupBy("kind", "value").agg(*(F.bit_or(w).alias(w) for w in words)).groupBy(*words).agg(F.count("*").alias("n"))
    has = [reduce(lambda x, y: x | y, (F.col(w).bitwiseAND(F.lit(b)) != 0 for w, b in zip(words, bits(i)) if b)) for i in range(len(columns))]
    members = masks.select("n", F.array_compact(F.array(*(F.when(h, F.lit(i)) for i, h in enumerate(has)))).alias("ids"))
    pairs = members.select("n", "ids", F.explode("ids").alias("child")).select("n", "child", F.explode("ids").alias("parent"))
    pairs = pairs.groupBy("child", "parent").agg(F.sum("n").alias("n_shared"))  # at most columns x columns rows

    filled = reduce(
        DataFrame.union,
        (
            df.agg(F.array(*(F.struct(F.lit(i).alias("id"), F.count(name).alias("n_filled")) for i, (t, name, _) in enumerate(columns) if t == table)).alias("c")).select(F.inline("c"))
            for table, df in tables.items()
            if any(t == table for t, _, _ in columns)
        ),
    )
    named = spark.createDataFrame([(i, t, c) for i, (t, c, _) in enumerate(columns)], "id int, table string, column_name string")
    distinct = pairs.where("child = parent").select(F.col("child").alias("id"), F.col("n_shared").alias("n_values"))
    facts = named.join(filled, "id").join(distinct, "id")

    def side(name: str) -> DataFrame:
        kept = [F.col("id").alias(name), F.col("table").alias(f"{name}_table"), F.col("column_name").alias(f"{name}_column")]
        return facts.select(*kept, *([F.col("n_values")] if name == "child" else [(F.col("n_values") == F.col("n_filled")).alias("parent_unique")]))

    found = pairs.where("child <> parent").join(F.broadcast(side("child")), "child").join(F.broadcast(side("parent")), "parent")  # a row a column
    return found.select(
        "child_table", "child_column", "parent_table", "parent_column", "n_values", "n_shared", (F.col("n_shared") / F.col("n_values")).alias("coverage"), "parent_unique"
    )


def references(found: DataFrame, least: float = 0.9) -> DataFrame:
    """The pairs of :func:`inclusions` that look like foreign keys: of two tables, into a unique column, with enough coverage.

    ``n_orphans`` are the child's values that the parent lacks.
    """
    likely = found.where(F.col("parent_unique") & (F.col("child_table") != F.col("parent_table")) & (F.col("coverage") >= least))
    return likely.withColumn("n_orphans", F.col("n_values") - F.col("n_shared"))
