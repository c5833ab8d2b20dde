"""Keys of several columns and functional dependencies, found in the rows.

Sets of columns are searched level by level.  A set is looked at only if it holds no smaller key and if its
columns have enough distinct values between them.  Most sets are ruled out by two equal rows in a slice of
the table, all rows of some values of a column of the set; what is left is verified on all rows.  Sets that
share a column are looked at together: its values deal the rows out once, and each task compares the rows
it has.  What the driver holds is bounded by the schema: a few numbers for each set of columns.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Collection, Iterator
from functools import reduce
from itertools import combinations
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Registers (as a power of two) of the sketches: a standard error of 0.8 %.
SKETCH_K = 14

#: The share of the rows, over ten standard errors below all of them, that an estimate must reach.
NEAR = 0.9

#: Of so many slices one is looked at, in turn; smaller slices than :data:`LEAST` rows are left out.
SLICES = (64, 8, 1)
LEAST = 10_000

#: Rows of a task, and of one value by which rows are dealt out, as a sample tells; a table of up to ALONE rows is not asked.
TASK = 200_000
SAMPLE = 100_000
ALONE = 1_000_000

#: Types that travel as they are.
FIXED = {"boolean", "tinyint", "smallint", "int", "bigint", "float", "double", "date", "timestamp", "timestamp_ntz"}

Columns = tuple[str, ...]


def figures(df: DataFrame, names: list[str]) -> tuple[int, dict[str, int]]:
    """The number of rows, and about how many distinct values each column without nulls has; one scan, one sketch a column."""
    filled = [F.count(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)]
    row = df.agg(F.count("*").alias("n"), *filled, *(F.hll_sketch_estimate(F.hll_sketch_agg(F.xxhash64(f"`{c}`"), SKETCH_K)).alias(f"d{i}") for i, c in enumerate(names))).first()
    return row.n, {c: row[f"d{i}"] for i, c in enumerate(names) if row[f"c{i}"] == row.n}


def crowded(df: DataFrame, names: list[str], n: int) -> set[str]:
    """Columns of which one value has over :data:`TASK` rows, as a sample tells; only how rows are dealt out depends on it."""
    if n <= ALONE:
        return set()
    cells = F.array(*(F.struct(F.lit(i).alias("id"), F.xxhash64(f"`{c}`").alias("value")) for i, c in enumerate(names)))
    cells = df.where(F.rand(0) < SAMPLE / n).select(F.explode(cells).alias("c")).select("c.*")
    most = cells.groupBy("id", "value").count().groupBy("id").agg(F.max("count").alias("most"))
    return {names[r.id] for r in most.collect() if r.most > max(10, SAMPLE * TASK / n)}  # a row a column


def dealt(sets: list[Columns], hot: set[str]) -> dict[Columns, list[Columns]]:
    """The sets by the columns whose values deal the rows out: one that many sets share, or the whole set if all its columns are crowded."""
    out: dict[Columns, list[Columns]] = {s: [s] for s in sets if hot.issuperset(s)}
    rest = [s for s in sets if not hot.issuperset(s)]
    while rest:
        shares = Counter(c for s in rest for c in s if c not in hot)
        most = min(shares, key=lambda c: (-shares[c], c))
        out[(most,)] = out.get((most,), []) + [s for s in rest if most in s]
        rest = [s for s in rest if most not in s]
    return out


def sharing(held: list[np.ndarray], places: list[list[int]]) -> list[int]:
    """Which of ``places`` (columns of ``held``) two rows share; rows whose sums are the same are compared."""
    odd = np.array([1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
    out = []
    for at, place in enumerate(places):
        total = np.zeros(len(held[0]), np.uint64)
        for i, c in enumerate(place):
            total += held[c] * odd[i % 4]
        ordered = np.sort(total)
        same = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        for start in range(0, len(same), 1_000):
            rows = np.isin(total, same[start : start + 1_000])
            cells = np.stack([held[c][rows] for c in place], axis=1)
            if len(np.unique(cells, axis=0)) < len(cells):
                out.append(at)
                break
    return out


def repeated(df: DataFrame, sets: list[Columns], n: int, hot: Collection[str] = (), slices: int = 1) -> set[Columns]:
    """Those of ``sets`` under which two of the ``n`` rows are the same, in one of ``slices`` of the values that deal the rows out.

    Numbers, truths, days and times are compared as such (0.0 and -0.0 are one); all else as two 64-bit hashes, so that two of
    a billion different values meet with a probability of 1e-20.
    """
    kinds, found = dict(df.dtypes), []
    for by, own in dealt(sets, set(hot)).items():
        used = sorted({c for s in own for c in s})
        cells = {c: [F.col(f"`{c}`")] if kinds[c] in FIXED else [F.xxhash64(F.lit(seed), F.col(f"`{c}`")) for seed in (1, 2)] for c in used}
        named = {c: [f"v{i}_{j}" for j in range(len(cells[c]))] for i, c in enumerate(used)}
        flat = [name for c in used for name in named[c]]
        rows = df.select(F.xxhash64(*(f"`{c}`" for c in by)).alias("key"), *(v.alias(name) for c in used for name, v in zip(named[c], cells[c])))
        if slices > 1:
            rows = rows.where(F.pmod("key", F.lit(slices)) == 0)
        rows = rows.repartition(-(-n // (slices * TASK)), "key")
        places = [[flat.index(name) for c in s for name in named[c]] for s in own]
        ids = [sets.index(s) for s in own]

        def run(batches: Iterator[pa.RecordBatch], places=places, ids=ids) -> Iterator[pa.RecordBatch]:
            parts = [[c.to_numpy(zero_copy_only=False) for c in batch.columns] for batch in batches if batch.num_rows]
            if parts:
                held = [np.concatenate(column).view(np.uint64) for column in zip(*parts)]
                yield pa.RecordBatch.from_arrays([pa.array([ids[at] for at in sharing(held, places)], pa.int32())], names=["id"])

        # a hash of a value of a fixed width is one to one
        found.append(rows.select(*(F.xxhash64(name).alias(name) for name in flat)).mapInArrow(run, "id int"))
    if not found:
        return set()
    return {sets[r.id] for r in reduce(DataFrame.union, found).distinct().collect()}  # at most a row a set


def minimal_keys(df: DataFrame, largest: int = 3) -> list[Columns]:
    """The sets of up to ``largest`` columns without nulls that no two rows share and that hold no smaller such set.

    Columns are in name order; an empty table has none.  Maps and other types that cannot be grouped are left out.
    """
    names = sorted(c for c, kind in df.dtypes if not kind.startswith(("map", "variant")))
    n, distinct = figures(df, names)
    if not n:
        return []
    names = list(distinct)
    hot = crowded(df, names, n)
    found: list[Columns] = []
    for size in range(1, largest + 1):
        sets = [s for s in combinations(names, size) if not any(set(key) <= set(s) for key in found)]
        sets = [s for s in sets if prod(distinct[c] for c in s) >= NEAR * n]
        for slices in (x for x in SLICES if x == 1 or n // x >= LEAST):
            same = repeated(df, sets, n, hot, slices)
            sets = [s for s in sets if s not in same]
        found += sets
    return found


def functional_dependencies(df: DataFrame) -> DataFrame:
    """determinant, dependent: the columns that have one value for each value of a column that itself repeats.

    A null is a value.  Keys, which determine everything, and columns of one value, which everything
    determines, are left out.  Every row is dealt out once a column; each value of a column keeps the
    least and greatest hash of all others, combined before the shuffle.
    """
    names = [c for c, kind in df.dtypes if not kind.startswith(("map", "variant"))]
    hashes = df.select(*(F.xxhash64(f"`{c}`").alias(f"h{i}") for i, c in enumerate(names)))
    cells = hashes.select(F.explode(F.array(*(F.struct(F.lit(i).alias("id"), F.col(f"h{i}").alias("value")) for i in range(len(names))))).alias("c"), "*")
    each = range(len(names))
    groups = cells.groupBy("c.id", "c.value").agg(F.count("*").alias("n"), *(f(f"h{i}").alias(f"{tag}{i}") for i in each for f, tag in ((F.min, "low"), (F.max, "high"))))
    facts = groups.groupBy("id").agg(F.max("n").alias("most"), F.count("*").alias("n_values"), *(F.bool_and(F.col(f"low{i}") == F.col(f"high{i}")).alias(f"one{i}") for i in each))
    constant = [r.id for r in facts.where("n_values = 1").select("id").collect()]  # at most a row a column
    holds = F.array_compact(F.array(*(F.when(F.col(f"one{i}"), F.lit(c)) for i, c in enumerate(names) if i not in constant)))
    named = F.element_at(F.array(*(F.lit(c) for c in names)), F.col("id") + 1)
    found = facts.where("most > 1 AND n_values > 1").select(named.alias("determinant"), F.explode(holds).alias("dependent"))
    return found.where("determinant <> dependent")
