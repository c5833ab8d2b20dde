"""Foreign-key checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COMPAT_MOST = 100


def orphan_rows(child: DataFrame, foreign: str, parent: DataFrame, primary: str) -> DataFrame:
    """The child rows whose key no parent has; a null key is an orphan here."""
    keys = parent.select(F.col(primary).alias("_parent_key"))
    return child.join(keys, child[foreign] == keys["_parent_key"], "left_anti")


def orphan_count(child: DataFrame, foreign: str, parent: DataFrame, primary: str) -> DataFrame:
    """n_orphans over all rows, n_null_keys of them, and n_reported (at most 100, as checks with a row limit report)."""
    found = orphan_rows(child, foreign, parent, primary)
    return found.agg(
        F.count("*").alias("n_orphans"),
        F.count_if(F.col(foreign).isNull()).alias("n_null_keys"),
        F.least(F.count("*"), F.lit(COMPAT_MOST)).cast("long").alias("n_reported"),
    )


def orphan_keys(child: DataFrame, foreign: str, parent: DataFrame, primary: str) -> DataFrame:
    """The distinct non-null child keys that no parent has (the two tables may be of different systems)."""
    keys = child.select(F.col(foreign).alias("key")).where("key IS NOT NULL").distinct()
    known = parent.select(F.col(primary).alias("key")).where("key IS NOT NULL")
    return keys.join(known, "key", "left_anti")
