"""Types, constraints and lookup tables inferred from profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Pairs of values that make a boolean column.
BOOLEAN_PAIRS = (("N", "Y"), ("NO", "YES"), ("F", "T"), ("FALSE", "TRUE"), ("0", "1"))


def with_values(profile: DataFrame, frequencies: DataFrame) -> DataFrame:
    """A profile with its frequent values as an array in order of rank; the values are at most ten a column."""
    lists = frequencies.groupBy("column_name").agg(F.sort_array(F.collect_list(F.struct("rank", "value"))).alias("_ranked"))
    return profile.join(lists, "column_name", "left").withColumn("values", F.transform("_ranked", lambda x: x["value"])).drop("_ranked")


def infer_type(name: Column, values: Column, distinct: Column, longest: Column, low: Column, high: Column) -> Column:
    """BOOLEAN, DATE or TIMESTAMPTZ, INTEGER or BIGINT, else VARCHAR of half as much again, in tens."""
    upper = F.array_sort(F.transform(values, F.upper))
    boolean = F.lit(False)
    for pair in BOOLEAN_PAIRS:
        boolean = boolean | (upper == F.array(*map(F.lit, pair)))
    first = values[0]
    year = F.substring(first, 1, 4).rlike("^[0-9]{4}$") | F.substring(first, 7, 4).rlike("^[0-9]{4}$")
    dated = F.lower(name).rlike("_dt|_dob|date|crtdt|upddt") & (F.length(first) >= 8) & year
    numeric = F.forall(values, lambda v: F.regexp_replace(v, "[-.]", "").rlike("^[0-9]+$"))
    whole = numeric & F.forall(values, lambda v: ~F.contains(v, F.lit(".")))
    wide = F.greatest(F.length(low), F.length(high)) > 9
    sized = F.greatest(F.lit(10), (F.ceil(F.floor(longest * 1.5) / 10) * 10)).cast("long")
    return (
        F.when((distinct == 2) & boolean, "BOOLEAN")
        .when(dated & (longest > 12), "TIMESTAMPTZ")
        .when(dated, "DATE")
        .when(whole & (distinct > 2), F.when(wide, "BIGINT").otherwise("INTEGER"))
        .otherwise(F.concat(F.lit("VARCHAR("), sized.cast("string"), F.lit(")")))
    )


# Families of legacy types, parts of names of dates, and bounds of a 32-bit integer.
TEXT_TYPES = ("character varying", "varchar", "text", "string", "char")
NUMBER_TYPES = ("numeric", "decimal", "number")
TIME_TYPES = ("timestamp", "timestamp without time zone", "timestamp with time zone")
DATE_NAMES = ("_date", "_dt", "dob", "birth")
INT_LOW, INT_HIGH = -2147483648, 2147483647


def numeric_bounds(df: DataFrame, columns: list[str]) -> DataFrame:
    """column_name, low, high of the numbers in each column, from one aggregation."""
    ends = [f(F.col(c).cast("string").try_cast("double")) for c in columns for f in (F.min, F.max)]
    pairs = F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(f"_{2 * i}").alias("low"), F.col(f"_{2 * i + 1}").alias("high")) for i, c in enumerate(columns)))
    return df.agg(*(e.alias(f"_{i}") for i, e in enumerate(ends))).select(F.inline(pairs))


def optimize_type(name: Column, legacy_type: Column, values: Column, distinct: Column, longest: Column, low: Column, high: Column) -> Column:
    """A tighter type than the legacy one: boolean pairs, texts of half as much again in tens, whole numbers, dates by name; else the legacy type."""
    base = F.trim(F.regexp_replace(F.lower(legacy_type), r"\(.*$", ""))
    upper = F.array_sort(F.transform(values, F.upper))
    pair = F.lit(False)
    for two in BOOLEAN_PAIRS:
        pair = pair | (upper == F.array(*map(F.lit, two)))
    sized = F.greatest(F.lit(10), F.ceil(F.floor(longest * 1.5) / 10) * 10).cast("long")
    text = F.when((distinct == 2) & pair, "BOOLEAN").when(longest > 0, F.concat(F.lit("VARCHAR("), sized.cast("string"), F.lit(")")))
    whole = (low == F.floor(low)) & (high == F.floor(high))
    number = F.when(whole & (low >= INT_LOW) & (high <= INT_HIGH), "INTEGER").when(whole, "BIGINT")
    dated = F.exists(F.array(*map(F.lit, DATE_NAMES)), lambda p: F.contains(F.lower(name), p))
    tight = F.when(base.isin(*TEXT_TYPES), text).when(base.isin(*NUMBER_TYPES), number).when(base.isin(*TIME_TYPES), F.when(dated, "DATE").otherwise("TIMESTAMPTZ"))
    return F.coalesce(tight, F.upper(legacy_type))


# Part of a tag -> what is done with the column, the first one counts.
PII_ACTIONS = {
    "SSN": "hash", "SOCIAL SECURITY": "hash", "PASSPORT": "hash", "DRIVER": "hash",
    "FINANCIAL": "archive", "CREDIT CARD": "archive", "BANK": "archive", "ACCOUNT": "archive",
    "EMAIL": "encrypt", "PHONE": "encrypt", "ADDRESS": "encrypt", "DOB": "restrict", "SALARY": "restrict", "INCOME": "restrict",
}


def pii_action(mapping_type: Column, rationale: Column, tag: Column, default: str = "hash") -> Column:
    """What is done with a personal column: by its mapping, else by its tag; null where neither says so."""
    upper = F.upper(tag)
    by_tag = F.when(F.contains(upper, F.lit("PII")) | F.contains(upper, F.lit("SENSITIVE")), default)
    for part, action in reversed(PII_ACTIONS.items()):
        by_tag = F.when(F.contains(upper, F.lit(part)), action).otherwise(by_tag)
    hashed = (mapping_type == "transform") & F.contains(F.lower(rationale), F.lit("hash"))
    return F.when(mapping_type == "archived", "archive").when(hashed, "hash").otherwise(by_tag)


def infer_constraints(profile: DataFrame) -> DataFrame:
    """column_name with NOT NULL, UNIQUE and the values of a CHECK, as the profile suggests."""
    unique = (F.col("unique_percent") >= 99.9) & F.lower("column_name").rlike("(_id|key|_hash|_code)$")
    listed = F.col("distinct_count").between(3, 10) & ~F.forall("values", lambda v: v.rlike("^[-0-9.]+$"))
    return profile.select(
        "column_name",
        (F.col("null_percent") == 0).alias("not_null"),
        unique.alias("is_unique"),
        F.when(listed, F.array_join(F.array_sort("values"), ",")).alias("check_in"),
    )


def lookup_candidates(profile: DataFrame, most_values: int = 20, few: int = 5) -> DataFrame:
    """Columns that could become lookup tables: few values, no key, and a telling name or very few values."""
    name = F.lower("column_name")
    telling = name.rlike("stat|type|code|categ|class|flag")
    return profile.where(
        F.col("distinct_count").between(1, most_values) & ~name.rlike("(_id|key|_recid)$") & (telling | (F.col("distinct_count") <= few))
    ).select("column_name", "distinct_count")


def profile_risks(profile: DataFrame, not_null: DataFrame, outliers: DataFrame | None = None) -> DataFrame:
    """(column_name, risk, severity): nulls under NOT NULL, mostly null, empty columns, and ``outliers`` (column_name)."""
    strict = profile.join(not_null.withColumn("strict", F.lit(True)), "column_name", "left")
    nulls = F.col("null_percent")
    risk = (
        F.when(F.coalesce("strict", F.lit(False)) & (nulls > 0), F.struct(F.lit("null_in_not_null").alias("risk"), F.lit("HIGH").alias("severity")))
        .when(nulls == 100, F.struct(F.lit("all_null").alias("risk"), F.lit("LOW").alias("severity")))
        .when(nulls > 50, F.struct(F.lit("mostly_null").alias("risk"), F.lit("MEDIUM").alias("severity")))
    )
    found = strict.withColumn("found", risk).where("found IS NOT NULL").select("column_name", "found.risk", "found.severity")
    return found if outliers is None else found.union(outliers.select("column_name", F.lit("extreme_outlier"), F.lit("MEDIUM")))


def outlier_columns(df: DataFrame, columns: list[str], deviations: float = 5) -> DataFrame:
    """(column_name): columns whose maximum lies more than ``deviations`` standard deviations above the mean, from one aggregation."""
    number = lambda c: F.col(c).cast("double")
    beyond = [((F.stddev_samp(number(c)) > 0) & (F.max(number(c)) > F.avg(number(c)) + deviations * F.stddev_samp(number(c)))).alias(c) for c in columns]
    return df.agg(*beyond).unpivot([], columns, "column_name", "extreme").where("extreme").select("column_name")
