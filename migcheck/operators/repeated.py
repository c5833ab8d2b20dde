"""Repeated groups, lookups and personal columns of flat tables, found in their names and values."""

from __future__ import annotations

import re
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from migcheck.functions.names import PII_KEYWORDS
from migcheck.operators import sketches
from migcheck.operators.reshape import unpivot_groups

#: Columns with a number: what stands before it names the group, the number the slot, the rest the attribute.
NUMBERED = re.compile(r"^(.*?)_?(\d+)_?(.*)$")

Groups = dict[str, dict[str, dict[str, str]]]  # group -> slot -> attribute -> column


def by_number(names: list[str]) -> Groups:
    """Groups of columns that differ by a number, in at least two slots; ``value`` is the attribute of a bare one."""
    found: Groups = defaultdict(lambda: defaultdict(dict))
    for name in names:
        if m := NUMBERED.match(name):
            found[m[1] or m[3]][m[2]][m[3] or "value"] = name
    return {group: dict(slots) for group, slots in found.items() if len(slots) > 1}


def by_domain(names: list[str], same: set[tuple[str, str]]) -> Groups:
    """Groups of columns with the same last word and values in common (``same``: pairs of columns); slots are the words before it."""
    ends: dict[str, list[str]] = defaultdict(list)
    for name in names:
        if "_" in name:
            ends[name.rpartition("_")[2]].append(name)
    out: Groups = {}
    for end, columns in ends.items():
        alike = [c for c in columns if any((c, d) in same for d in columns if d != c)]
        if len(alike) > 1:
            out[end] = {c.rpartition("_")[0]: {"value": c} for c in alike}
    return out


def shared_domains(df: DataFrame, least: float = 0.2) -> set[tuple[str, str]]:
    """Pairs of columns of one type whose sets of values have a Jaccard similarity of at least ``least``, by their theta sketches."""
    kinds = dict(df.dtypes)
    found = sketches.column_sketches(df).select("column_name", "theta")
    other = found.toDF("other", "other_theta")
    both = found.join(other, F.col("column_name") != F.col("other"))  # a row a column on either side
    shared = F.theta_sketch_estimate(F.theta_intersection("theta", "other_theta"))
    alike = both.where(shared >= least * F.theta_sketch_estimate(F.theta_union("theta", "other_theta"))).where(shared > 0)
    return {(r.column_name, r.other) for r in alike.select("column_name", "other").collect() if kinds[r.column_name] == kinds[r.other]}


def repeated_groups(df: DataFrame, least: float = 0.2) -> Groups:
    """The repeated groups of a table: by numbers in the names, and among all other columns by last word and values in common.

    Slots of a group that lack an attribute of the others have it as null when they become rows.
    """
    found = by_number(df.columns)
    taken = {c for slots in found.values() for columns in slots.values() for c in columns.values()}
    rest = [c for c in df.columns if c not in taken]
    return found | by_domain(rest, shared_domains(df.select(*rest), least) if rest else set())


def as_rows(df: DataFrame, key: str, slots: dict[str, dict[str, str]]) -> DataFrame:
    """``key``, kind (the slot) and the attributes of a group: a row for each slot that is not empty."""
    attributes = list(dict.fromkeys(a for columns in slots.values() for a in columns))
    kinds = {c: kind for c, kind in df.dtypes}
    full = {}
    for slot, columns in slots.items():
        for a in attributes:
            if a not in columns:
                like = next(c[a] for c in slots.values() if a in c)
                df = df.withColumn(f"none_{slot}_{a}", F.lit(None).cast(kinds[like]))
        full[slot] = {a: columns.get(a, f"none_{slot}_{a}") for a in attributes}
    return unpivot_groups(df, key, full)


def lookup_columns(df: DataFrame, most: int = 15, share: float = 0.5) -> list[str]:
    """Columns of 3 to ``most`` different values, and of fewer than a share of the rows: candidates for tables of their own."""
    names = [f.name for f in sketches.usable(df)]
    row = df.agg(F.count("*").alias("n_"), *(F.approx_count_distinct(f"`{c}`", 0.02).alias(c) for c in names)).first()  # exact at so few values
    return [c for c in names if 2 < row[c] <= most and row[c] < share * row["n_"]]


def personal_columns(df: DataFrame) -> list[str]:
    """Columns whose names tell of personal data; two or more belong in a table of their own."""
    return [c for c in df.columns if any(word in c.lower() for word in PII_KEYWORDS)]
