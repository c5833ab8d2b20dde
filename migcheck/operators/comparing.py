"""Comparison of a legacy and a modern table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from migcheck.functions.compare import parsed, same_reading, shortened


def row_count(legacy: DataFrame, modern: DataFrame) -> DataFrame:
    """Both counts, the difference, the penalty (its percentage of the legacy rows, 30 at most) and the status."""
    counts = legacy.agg(F.count("*").alias("legacy_rows")).join(F.broadcast(modern.agg(F.count("*").alias("modern_rows"))))  # one row each
    gap = F.abs(F.col("legacy_rows") - F.col("modern_rows"))
    penalty = F.when(F.col("legacy_rows") > 0, F.least(gap * 100.0 / F.col("legacy_rows"), F.lit(30.0))).otherwise(0.0)
    return counts.select(
        "legacy_rows", "modern_rows", gap.alias("difference"), F.round(penalty, 4).alias("penalty"), F.when(gap == 0, "PASS").otherwise("FAIL").alias("status")
    )


def sample_keys(df: DataFrame, key: str, n: int) -> DataFrame:
    """``n`` keys in the order of the MD5 of their text: the same ones in every run and engine."""
    return df.select(key).where(F.col(key).isNotNull()).orderBy(F.md5(F.col(key).cast("string").cast("binary")), key).limit(n)


def one_per_key(df: DataFrame, key: str, order: list[Column | str]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_at", F.row_number().over(W.partitionBy(key).orderBy(*order))).where("_at = 1").drop("_at")


def matched(legacy: DataFrame, modern: DataFrame, key: tuple[str, str], pairs: list[tuple[str, str]], latest: tuple[str, str] | None = None) -> DataFrame:
    """key, one boolean for each pair of columns, ``equal`` and ``differences`` of the keys on both sides.

    A key is matched once: of rows that repeat it the last counts, by the columns named in ``latest``, else
    by all values.  Keys meet as trimmed text.  Values with the same text are the same; only the others are
    read as booleans, dates and numbers.
    """

    def side(df: DataFrame, own: int) -> DataFrame:
        names = [p[own] for p in pairs]
        time = [F.col(latest[own]).alias("_latest")] if latest else []
        kept = df.select(F.trim(F.col(key[own]).cast("string")).alias("key"), *time, *(F.col(c).cast("string").alias(f"_{own}_{i}") for i, c in enumerate(names)))
        order = [F.desc_nulls_last("_latest")] if latest else []
        return one_per_key(kept.where("key IS NOT NULL"), "key", [*order, *(F.desc_nulls_last(f"_{own}_{i}") for i in range(len(names)))])

    def agree(i: int) -> Column:
        a, b = F.col(f"_0_{i}"), F.col(f"_1_{i}")
        return F.when(a.eqNullSafe(b), True).otherwise(same_reading(parsed(a), parsed(b)))

    joined = side(legacy, 0).join(side(modern, 1), "key")
    both = joined.select("key", *(agree(i).alias(f"same_{b}") for i, (_, b) in enumerate(pairs)), *(F.col(f"_{own}_{i}") for own in (0, 1) for i in range(len(pairs))))
    differences = F.array_compact(F.array(*(
        F.when(~F.col(f"same_{b}"), F.struct(F.lit(b).alias("column_name"), F.col(f"_0_{i}").alias("legacy"), F.col(f"_1_{i}").alias("modern")))
        for i, (_, b) in enumerate(pairs)
    )))
    equal = reduce(lambda x, y: x & y, (F.col(f"same_{b}") for _, b in pairs))
    return both.select("key", *(f"same_{b}" for _, b in pairs), equal.alias("equal"), differences.alias("differences"))


#: Rows looked at for each key of a sample, before all keys are reduced to different ones.
ROWS_A_KEY = 8


def sampled(legacy: DataFrame, modern: DataFrame, key: tuple[str, str], n: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(keys, legacy rows, modern rows) of ``n`` sampled keys: both tables are reduced by a semi join before any row is compared.

    The first rows in the order of the sample hold the keys, as a key's rows stand together there; only where
    they repeat too few keys too often are all keys reduced first.
    """
    rows = sample_keys(legacy, key[0], ROWS_A_KEY * n).collect()  # a bounded number of keys
    found = list(dict.fromkeys(r[0] for r in rows))[:n]
    if len(found) < n and len(rows) == ROWS_A_KEY * n:
        found = [r[0] for r in sample_keys(legacy.select(key[0]).distinct(), key[0], n).collect()]
    keys = F.broadcast(legacy.sparkSession.createDataFrame([(k,) for k in found], T.StructType([legacy.schema[key[0]]])).coalesce(1))  # n rows
    return keys, legacy.join(keys, key[0], "left_semi"), modern.join(keys.withColumnRenamed(key[0], key[1]), key[1], "left_semi")


def sample_compare(
    legacy: DataFrame, modern: DataFrame, key: tuple[str, str], pairs: list[tuple[str, str]], n: int = 100, latest: tuple[str, str] | None = None
) -> DataFrame:
    """Match rate of ``n`` sampled records, with its penalty and status; repeated keys count once (see :func:`matched`)."""
    keys, old, new = sampled(legacy, modern, key, n)
    found = matched(old, new, key, pairs, latest)
    rate = F.try_divide(F.count_if(F.col("equal")) * 100.0, F.count("*"))
    total = found.agg(F.count("*").alias("matched_keys"), F.count_if(F.col("equal")).alias("equal_rows"), rate.alias("rate"))
    asked = keys.agg(F.count("*").alias("sampled"))
    return total.join(F.broadcast(asked)).select(  # one row each
        "sampled",
        "matched_keys",
        (F.col("sampled") - F.col("matched_keys")).alias("missing_keys"),
        "equal_rows",
        F.round("rate", 4).alias("match_rate"),
        F.round(F.coalesce((100 - F.col("rate")) * 0.3, F.lit(30.0)), 4).alias("penalty"),
        F.when(F.col("rate") == 100, "PASS").when((F.col("rate") >= 90) | F.col("rate").isNull(), "WARN").otherwise("FAIL").alias("status"),
    )


def sample_differences(
    legacy: DataFrame, modern: DataFrame, key: tuple[str, str], pairs: list[tuple[str, str]], n: int = 100, rows: int = 10, columns: int = 5, latest: tuple[str, str] | None = None
) -> DataFrame:
    """(key, column_name, legacy, modern): the first ``columns`` differences of the first ``rows`` sampled records that differ.

    Values are shown by their first 50 characters.
    """
    _, old, new = sampled(legacy, modern, key, n)
    differ = matched(old, new, key, pairs, latest).where(~F.col("equal")).orderBy("key").limit(rows)
    return differ.select("key", F.explode(F.slice("differences", 1, columns)).alias("d")).select("key", "d.column_name", shortened(F.col("d.legacy"), 50).alias("legacy"), shortened(F.col("d.modern"), 50).alias("modern"))


def compare_groups(legacy: DataFrame, modern: DataFrame, keys: list[str], values: list[str], tolerance: float = 0) -> DataFrame:
    """Full outer comparison of two aggregates: keys, both values, whether they agree; missing groups count as 0."""
    left = legacy.select(*keys, *(F.col(v).alias(f"legacy_{v}") for v in values))
    right = modern.select(*keys, *(F.col(v).alias(f"modern_{v}") for v in values))
    both = left.join(right, keys, "full_outer")
    zero = lambda side, v: F.coalesce(F.col(f"{side}_{v}"), F.lit(0))
    agree = reduce(lambda x, y: x & y, (F.abs(zero("legacy", v) - zero("modern", v)) <= tolerance for v in values))
    return both.withColumn("agrees", agree)
