"""Every query with an oracle against DuckDB on the same files."""

from __future__ import annotations

import datetime
import decimal

import duckdb
import pytest

from migcheck import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("key", sorted(queries.ORACLES))
def test_query_equals_oracle(spark, sf_dir, duck, key):
    got = queries.QUERIES[key](spark, sf_dir)
    expected = duck.sql(queries.ORACLES[key])
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(expected.columns, expected.fetchall())


def test_expand_abbrev(spark, sf_dir):
    got = {r.source: r.expanded for r in queries.QUERIES["expand_abbrev"](spark, sf_dir).collect()}
    assert got["cl_fnam"] == "first_name" and got["bp_payam"] == "payment_amount" and got["cl_fil1"] == "_filler"
    assert got["cl_recid"] == "_record_id" and got["email_address"] == "email_address" and got["cl_ssn"] == "ssn"


def test_match_columns(spark, sf_dir):
    got = {(r.table, r.source): (r.target, r.confidence) for r in queries.QUERIES["match_columns"](spark, sf_dir).collect()}
    assert got["claimants", "cl_recid"] == ("claimant_id", 0.95)
    assert got["claimants", "cl_fnam"] == ("first_name", 0.95)
    assert got["claims", "cm_clmnt"] == ("claimant_id", 0.95)
    assert got["claims", "cm_stat"][0] == "claim_status"
    assert got["payments", "CreatedAt"][0] == "created_at"
    assert ("claimants", "cl_bact") not in got and ("claimants", "cl_fil1") not in got


def test_entry(spark):
    import __spark_entry__

    row = __spark_entry__.entry(spark).first()
    assert 0 <= row.score < 100 and row.status == "FAIL"
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
