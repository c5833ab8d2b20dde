"""Physical plans: pruned scans, pushed filters, no products of tables."""

from __future__ import annotations

import re

import pytest

from migcheck import queries


def plan_of(df):
    return df._jdf.queryExecution().toString()


def scanned(plan):
    return {c for m in re.findall(r"ReadSchema: struct<([^>]*)", plan.partition("== Physical Plan ==")[2]) for c in re.findall(r"(\w+):", m)}


@pytest.mark.parametrize(
    "key, columns",
    [
        ("orphans_same_source", {"o_orderkey", "o_custkey", "c_custkey"}),
        ("duplicate_count", {"o_custkey"}),
        ("column_checksum", {"o_orderkey", "o_orderstatus"}),
        ("extreme_outlier", {"l_extendedprice"}),
        ("freshness", {"ts"}),
        ("value_frequencies", {"o_orderpriority", "o_orderstatus", "o_custkey"}),
    ],
)
def test_scans_read_only_what_is_needed(spark, sf_dir, key, columns):
    assert scanned(plan_of(queries.QUERIES[key](spark, sf_dir))) == columns


def test_big_tables_meet_by_keys(spark, sf_dir):
    for key in ("keyed_compare", "orphans_cross_source", "reconstruct_flat", "normalization_integrity"):
        physical = plan_of(queries.QUERIES[key](spark, sf_dir)).partition("== Physical Plan ==")[2]
        assert "CartesianProduct" not in physical and "Python" not in physical


def test_profile_has_two_aggregations_for_all_columns(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/customer.parquet")
    from migcheck.operators.profile import column_profile

    physical = plan_of(column_profile(df)).partition("== Physical Plan ==")[2]
    assert physical.count("Scan parquet") == 1 and physical.count("Exchange") <= 2
