"""Which entities a flat table holds, from its column names and profile, as DataFrames of one row a column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Parts of column names (without prefix) that belong to an address or a contact, and endings of keys.
ADDRESS = ("adr", "addr", "address", "street", "line1", "line2", "city", "town", "state", "st", "province", "zip", "zipcode", "postal", "country")
CONTACT = ("phon", "phone", "tel", "fax", "emal", "email", "mail")
KEY_ENDINGS = ("_recid", "_id", "recid", "_pk", "_key")

PREFIX = r"^([A-Za-z]{2,4})_"


def column_groups(schema: DataFrame, least: int = 3) -> DataFrame:
    """(table, column_name) with ``prefix`` and ``confidence`` of the group that each column belongs to.

    A prefix with ``least`` columns makes a group.  All other columns of the table go to its largest group
    (ties by prefix); a table without groups is one group of its own, with an empty prefix.
    """
    own = F.lower(F.regexp_extract("column_name", PREFIX, 1))
    named = schema.select("table", "column_name", own.alias("own"))
    sizes = named.groupBy("table", "own").agg(F.count("*").alias("size")).where((F.col("own") != "") & (F.col("size") >= least))
    groups = sizes.groupBy("table").agg(F.count("*").alias("n"), F.min(F.struct((-F.col("size")).alias("less"), "own")).alias("largest"))
    groups = groups.select("table", "n", F.col("largest.own").alias("largest"))
    placed = named.join(sizes.select("table", "own", F.lit(True).alias("grouped")), ["table", "own"], "left").join(groups, "table", "left")
    prefix = F.when(F.col("grouped"), F.col("own")).otherwise(F.coalesce("largest", F.lit("")))
    sure = F.when(F.col("n").isNull(), 0.8).when(F.col("n") == 1, 0.9).otherwise(0.7)
    return placed.select("table", "column_name", prefix.alias("prefix"), sure.alias("confidence"))


def _has(parts: tuple[str, ...]) -> Column:
    bare = F.regexp_replace(F.lower("column_name"), r"^[a-z]{2,4}_", "")
    return F.exists(F.array(*map(F.lit, parts)), lambda p: F.contains(bare, p))


def sub_entities(groups: DataFrame, least: int = 3) -> DataFrame:
    """Groups with ``part``: addresses or contacts where a group has ``least`` such columns, else main."""
    kind = F.when(_has(ADDRESS), "addresses").when(_has(CONTACT), "contacts").otherwise("main")
    size = F.count("*").over(W.partitionBy("table", "prefix", "part"))  # columns of one table
    return groups.withColumn("part", kind).withColumn("part", F.when(size >= least, F.col("part")).otherwise("main"))


def entity_keys(parts: DataFrame, profile: DataFrame) -> DataFrame:
    """table, prefix, part, n_columns, key_column, confidence of each entity.

    The key is the first column (by name) that ends like a key, unique ones first; addresses and contacts
    get keys of their own later.  Profiled columns raise the confidence by up to a tenth.
    """
    known = profile.select("table", "column_name", "unique_percent", F.lit(True).alias("profiled"))
    rows = parts.join(known, ["table", "column_name"], "left")
    ends = F.lower("column_name").rlike("(" + "|".join(KEY_ENDINGS) + ")$") & (F.col("part") == "main")
    rank = F.struct((F.coalesce("unique_percent", F.lit(0.0)) < 99.9).alias("repeats"), "column_name")
    share = F.count("profiled") / F.count("*")
    return rows.groupBy("table", "prefix", "part").agg(
        F.count("*").alias("n_columns"),
        F.min(F.when(ends, rank))["column_name"].alias("key_column"),
        F.round(F.least(F.lit(1.0), F.max("confidence") + share * 0.1), 4).alias("confidence"),
    )


# The order in which entities of a plan are made.
ROLES = ("lookup", "primary", "child")


def normalization_plan(entities: DataFrame, lookups: DataFrame) -> DataFrame:
    """table, position, entity, role, key_column, parent, foreign_key of each entity, in the order of their making.

    Of a table's entities the main one with most columns (ties by prefix) is primary and the others are its
    children; ``lookups`` (table, prefix, column_name) become tables of codes, named by the group and what they list.
    """
    base = F.regexp_replace(F.when(F.col("prefix") != "", F.col("prefix")).otherwise(F.col("table")), "s+$", "")
    listed = F.when(F.col("bare").rlike("(stat|status)$"), "status").when(F.col("bare").rlike("(type|typ)$"), "type").when(F.col("bare").rlike("(code|cd)$"), "code")
    named = entities.withColumns({"base": base, "entity": F.when(F.col("part") == "main", base).otherwise(F.concat_ws("_", base, "part"))})
    first = W.partitionBy("table").orderBy(F.col("part") != "main", F.desc("n_columns"), "prefix", "part")  # entities of one table
    ranked = named.withColumns({"at": F.row_number().over(first), "parent": F.first("entity").over(first), "parent_base": F.first("base").over(first)})
    child = F.col("at") > 1
    own = ranked.select(
        "table", "entity", F.when(child, "child").otherwise("primary").alias("role"), F.coalesce("key_column", F.concat("entity", F.lit("_id"))).alias("key_column"),
        F.when(child, F.col("parent")).alias("parent"), F.when(child, F.concat("parent_base", F.lit("_id"))).alias("foreign_key"),
    )
    bare = F.regexp_replace(F.lower("column_name"), "^[a-z]{2,4}_", "")
    called = F.coalesce(F.concat("base", F.lit("_"), listed), F.concat("bare", F.lit("_lookup")))
    codes = lookups.withColumns({"base": base, "bare": bare}).select("table", called.alias("entity"), F.lit("lookup").alias("role"), F.lit("code").alias("key_column"), F.lit(None).cast("string"), F.lit(None).cast("string"))
    rank = F.array_position(F.array(*map(F.lit, ROLES)), F.col("role"))
    return own.union(codes).withColumn("position", F.row_number().over(W.partitionBy("table").orderBy(rank, "entity")))
