"""Mergeable sketches of columns: distinct counts, quantiles and overlaps without a second look at the rows.

One scan gives a row a column with a HyperLogLog and a theta sketch of its values and, for numbers, a KLL
sketch.  Rows of several days, partitions or tables merge into those of the whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Sizes of the sketches: HyperLogLog 2**14 registers (0.8 % standard error), theta 2**14 entries (0.8 %), KLL k=800 (0.35 % of rank).
HLL_K = THETA_K = 14
KLL_K = 800


def usable(df: DataFrame) -> list[T.StructField]:
    return [f for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.ArrayType, T.StructType, T.VariantType))]


def column_sketches(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``by``, column_name, n, n_null, hll, theta, kll of every column; ``by`` (days, say) gives a row for each of its values too.

    Columns of nested types are left out.  ``kll`` is null for columns that are not numbers.
    """
    by = by or []
    fields = [f for f in usable(df) if f.name not in by]

    def one(f: T.StructField) -> Column:
        name = F.col(f"`{f.name}`")
        text = name.cast("string")
        numbers = F.kll_sketch_agg_double(name.cast("double"), KLL_K) if isinstance(f.dataType, T.NumericType) else F.lit(None).cast("binary")
        return F.struct(
            F.lit(f.name).alias("column_name"), F.count("*").alias("n"), F.count_if(name.isNull()).alias("n_null"),
            F.hll_sketch_agg(text, HLL_K).alias("hll"), F.theta_sketch_agg(text, THETA_K).alias("theta"), numbers.alias("kll"),
        )

    rows = df.groupBy(*by).agg(F.array(*map(one, fields)).alias("columns"))
    return rows.select(*by, F.inline("columns"))


def merged(parts: DataFrame, by: list[str]) -> DataFrame:
    """Sketches of the whole out of those of parts; ``by`` is what stays apart (column_name, say)."""
    return parts.groupBy(*by).agg(
        F.sum("n").alias("n"),
        F.sum("n_null").alias("n_null"),
        F.hll_union_agg("hll").alias("hll"),
        F.theta_union_agg("theta").alias("theta"),
        reduce_kll(F.collect_list("kll")).alias("kll"),
    )


def reduce_kll(sketches: Column) -> Column:
    """One KLL sketch out of a column's (a row a part, so a short list of small values)."""
    whole = F.aggregate(F.slice(sketches, 2, F.greatest(F.size(sketches), F.lit(1))), F.element_at(F.nullif(sketches, F.array().cast("array<binary>")), 1), F.kll_sketch_merge_double)
    return F.when(F.size(sketches) > 0, whole)


def estimates(sketches: DataFrame, quantiles: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """The columns of ``sketches`` with distinct_estimate and, for numbers, the quantiles as an array."""
    found = F.array(*(F.kll_sketch_get_quantile_double("kll", F.lit(q)) for q in quantiles))
    return sketches.withColumn("distinct_estimate", F.hll_sketch_estimate("hll")).withColumn("quantiles", F.when(F.col("kll").isNotNull() & (F.col("n") > F.col("n_null")), found))


def overlap(left: DataFrame, right: DataFrame) -> DataFrame:
    """left_column, right_column, n_shared, coverage: about how many values of each left column the right one has (rows of :func:`column_sketches`)."""
    a = left.select(F.col("column_name").alias("left_column"), F.col("theta").alias("a"))
    b = right.select(F.col("column_name").alias("right_column"), F.col("theta").alias("b"))
    both = a.crossJoin(b)  # a row a column on either side
    shared = F.theta_sketch_estimate(F.theta_intersection("a", "b"))
    return both.select("left_column", "right_column", shared.alias("n_shared"), F.try_divide(shared, F.theta_sketch_estimate("a")).alias("coverage"))


def drift(before: DataFrame, now: DataFrame, distinct: float = 0.1, rank: float = 0.05) -> DataFrame:
    """column_name, change (distinct, quantile), detail: columns whose sketches moved beyond the thresholds.

    ``distinct`` is the relative change of the distinct count; a quantile changed if the median now lies
    outside of the values that had ranks within ``rank`` of the middle.  Both lie over the sketches' own errors.
    """
    a = estimates(before, (0.5 - rank, 0.5 + rank)).select("column_name", F.col("distinct_estimate").alias("was"), F.col("quantiles").alias("band"))
    b = estimates(now, (0.5,)).select("column_name", F.col("distinct_estimate").alias("is"), F.col("quantiles")[0].alias("median"))
    both = a.join(b, "column_name")  # columns that are on both sides; others are schema drift
    band = F.concat_ws(" to ", F.col("band").cast("array<string>"))
    moved = F.array_compact(F.array(
        F.when(F.abs(F.col("is") - F.col("was")) > distinct * F.greatest("was", F.lit(1)), F.struct(F.lit("distinct").alias("change"), F.concat_ws(" -> ", F.col("was").cast("string"), F.col("is").cast("string")).alias("detail"))),
        F.when((F.col("median") < F.col("band")[0]) | (F.col("median") > F.col("band")[1]), F.struct(F.lit("quantile").alias("change"), F.concat(band, F.lit(" -> "), F.col("median").cast("string")).alias("detail"))),
    ))
    return both.select("column_name", F.inline(moved))
