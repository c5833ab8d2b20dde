"""Hierarchical checksums: trees of digests over ranges of keys, compared from the root down.

The leaves are ranges of a whole-number key; a leaf's digest is the sum of the hashes of its rows, so it is
combined before the shuffle and does not depend on their order.  An inner node sums up ``FANOUT`` nodes of
the level below.  Two tables are compared level by level, only below nodes that differ, and rows are read
only in the ranges of the leaves that differ: as range filters that reach the scan where the ranges are few.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from migcheck.operators.checksum import row_text, short_hash

FANOUT = 16

#: Up to so many ranges are pushed to the scan as filters; more are joined.
MOST_RANGES = 200


def leaf_of(key: str, width: int) -> Column:
    """The number of a key's range; rows without a key are in one of their own (null)."""
    return F.floor(F.col(key) / F.lit(width)).cast("long")


def tree(df: DataFrame, key: str, columns: list[str], width: int = 1_000, levels: int = 4) -> DataFrame:
    """level (0: leaves), node, n, digest; ``levels`` levels above the leaves, of which the last one is a single root."""
    node = leaf_of(key, width)
    at = df.groupBy(node.alias("node")).agg(F.count("*").alias("n"), F.sum(short_hash(row_text(columns))).alias("digest")).withColumn("level", F.lit(0))
    parts = [at]
    for level in range(1, levels + 1):
        above = F.floor(F.col("node") / FANOUT).cast("long") if level < levels else F.lit(0).cast("long")
        at = at.groupBy(above.alias("node")).agg(F.sum("n").alias("n"), F.sum("digest").alias("digest")).withColumn("level", F.lit(level))
        parts.append(at)
    return reduce(DataFrame.unionByName, parts).select("level", "node", "n", F.col("digest").cast("string").alias("digest"))


def differing_nodes(left: DataFrame, right: DataFrame, levels: int = 4) -> DataFrame:
    """level, node: the nodes that differ, found from the root down; nodes below equal ones are not compared.

    ``left`` and ``right`` are stored trees; each step reads one level of them.
    """

    def compared(level: int, inside: DataFrame | None) -> DataFrame:
        def of(side: DataFrame) -> DataFrame:
            rows = side.where(F.col("level") == level).select("node", "n", "digest")
            if inside is None or level == levels - 1:  # all nodes of the level below the root have it above them
                return rows
            above = F.floor(F.col("node") / FANOUT).cast("long")
            return rows.join(inside.select(F.col("node").alias("above_")), above.eqNullSafe(F.col("above_")), "left_semi")

        a, b = of(left), of(right).toDF("node_", "n_", "digest_")
        both = a.join(b, F.col("node").eqNullSafe(F.col("node_")), "full_outer")
        same = F.col("n").eqNullSafe(F.col("n_")) & F.col("digest").eqNullSafe(F.col("digest_"))
        return both.where(~same).select(F.lit(level).alias("level"), F.coalesce("node", "node_").alias("node"))

    at = compared(levels, None)
    parts = [at]
    for level in range(levels - 1, -1, -1):
        at = compared(level, at)
        parts.append(at)
    return reduce(DataFrame.union, parts)


def in_leaves(df: DataFrame, key: str, leaves: DataFrame, width: int) -> DataFrame:
    """The rows of ``df`` in the ranges ``leaves`` (node); a few ranges become filters of the scan, adjoining ones as one."""
    some = [r.node for r in leaves.select("node").limit(MOST_RANGES * FANOUT + 1).collect()]
    ranges: list[list[int]] = []
    for node in sorted(n for n in some if n is not None):
        if ranges and ranges[-1][1] == node * width:
            ranges[-1][1] += width
        else:
            ranges.append([node * width, (node + 1) * width])
    if len(some) > MOST_RANGES * FANOUT or len(ranges) > MOST_RANGES:
        return df.join(leaves.select(F.col("node").alias("node_")), leaf_of(key, width).eqNullSafe(F.col("node_")), "left_semi")
    keep = F.col(key).isNull() if None in some else F.lit(False)
    return df.where(reduce(lambda x, y: x | y, ((F.col(key) >= low) & (F.col(key) < high) for low, high in ranges), keep))


def differing_keys(left: DataFrame, right: DataFrame, key: str, columns: list[str], leaves: DataFrame, width: int = 1_000) -> DataFrame:
    """key, change (missing: only left; added: only right; changed) of the rows in ``leaves``.

    A key that repeats is changed if its rows, taken together, differ.  Rows without a key count as one key.
    """

    def side(df: DataFrame, name: str) -> DataFrame:
        rows = in_leaves(df, key, leaves, width).groupBy(F.col(key).alias(f"{name}_key"))
        return rows.agg(F.count("*").alias(f"{name}_n"), F.sum(short_hash(row_text(columns))).alias(f"{name}_digest"))

    both = side(left, "left").join(side(right, "right"), F.col("left_key").eqNullSafe(F.col("right_key")), "full_outer")
    change = F.when(F.col("right_n").isNull(), "missing").when(F.col("left_n").isNull(), "added")
    change = change.when((F.col("left_n") != F.col("right_n")) | (F.col("left_digest") != F.col("right_digest")), "changed")
    return both.select(F.coalesce("left_key", "right_key").alias("key"), change.alias("change")).where("change IS NOT NULL")
