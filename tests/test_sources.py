"""Record files in byte ranges, databases over JDBC (the one among Spark's own jars), catalog exports."""

from __future__ import annotations

import json
import os

import pyspark
import pytest
from pyspark.sql import functions as F

from migcheck.sources import discovery, jdbc, records
from migcheck.sources.tables import read_source

HAS_DERBY = any(name.startswith("derby-") for name in os.listdir(os.path.join(os.path.dirname(pyspark.__file__), "jars")))


@pytest.mark.parametrize("tail", [b"", b"xy"])
def test_records_of_all_files(spark, tmp_path, tail):
    (tmp_path / "more").mkdir()
    (tmp_path / "a.bin").write_bytes(b"".join(b"%05d" % i for i in range(1000)) + tail)
    (tmp_path / "more" / "b.bin").write_bytes(b"".join(b"%05d" % i for i in range(1000, 1300)))
    (tmp_path / "empty.bin").write_bytes(b"")
    rows = records.read_records(spark, str(tmp_path), 5, range_bytes=512)
    assert sorted(int(bytes(r.record)) for r in rows.collect()) == list(range(1300))
    assert rows.rdd.getNumPartitions() == -(-5000 // 510) + -(-1500 // 510)
    assert records.read_records(spark, str(tmp_path / "empty.bin"), 5).count() == 0


def test_large_files_are_planned_in_ranges(spark, tmp_path):
    with open(tmp_path / "large.bin", "wb") as file:
        file.truncate(3 << 30)  # takes no room on disk
    files = records.listed(spark, str(tmp_path))
    parts = records.ranges(files, 120, records.RANGE_BYTES)
    assert len(parts) > 40 and sum(p.length for p in parts) == (3 << 30) // 120 * 120 and all(p.length % 120 == p.start % 120 == 0 for p in parts)
    reader = records.RecordReader({"files": json.dumps(files), "size": "120"})
    assert next(iter(reader.read(parts[0]))).num_rows == records.BATCH_BYTES // 120
    with pytest.raises(ValueError):
        records.read_records(spark, str(tmp_path), 0)


@pytest.fixture
def database(tmp_path):
    if not HAS_DERBY:
        pytest.skip("no embedded database among the jars")
    return {"type": "derby", "database": str(tmp_path / "db"), "partitions": 4}


def test_jdbc_round_trip(spark, sf_dir, database):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    jdbc.write_jdbc(orders, database, "orders")
    back = read_source(spark, database, "orders")
    assert back.rdd.getNumPartitions() == 4  # bounds from the source, on the first whole-number column
    assert back.exceptAll(orders).count() == orders.exceptAll(back).count() == 0
    plan = back.where("o_custkey = 7").select("o_orderkey")._jdf.queryExecution().toString()
    assert "EqualTo(o_custkey,7)" in plan and "ReadSchema: struct<o_orderkey" in plan
    some = read_source(spark, database, 'SELECT "o_orderkey", "o_orderstatus" FROM orders WHERE "o_totalprice" > 100000')
    assert some.count() == orders.where("o_totalprice > 100000").count()
    assert read_source(spark, database, 'SELECT "o_orderkey" FROM orders WHERE "o_orderkey" < 0').count() == 0


def test_truncate_keeps_the_definition(spark, database):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string")
    jdbc.write_jdbc(rows, database | {"partitions": 1}, "t")
    before = jdbc.ask(spark, database, "SELECT COUNT(*) AS n FROM t").schema
    jdbc.write_jdbc(rows.limit(1), database, "t", "truncate")
    jdbc.write_jdbc(rows.withColumn("id", F.col("id") + 10), database, "t", "append")
    assert sorted(r.id for r in jdbc.read_jdbc(spark, database, "t").collect()) == [1, 11, 12]
    assert jdbc.ask(spark, database, "SELECT COUNT(*) AS n FROM t").schema == before


def test_statistics_are_the_source_s(spark, database):
    jdbc.write_jdbc(spark.createDataFrame([(1, 7, 5), (2, 7, None), (3, None, 5), (None, 8, 9)], "id long, name long, parent long"), database, "child", types="name INTEGER")
    jdbc.write_jdbc(spark.createDataFrame([(5,), (6,)], "id long"), database, "parent")
    got = {r.column_name: tuple(r)[1:] for r in jdbc.column_statistics(spark, database, "child", ["id", "name", "parent"]).collect()}
    assert got == {"id": (4, 1, 3, 0), "name": (4, 1, 2, 1), "parent": (4, 1, 2, 1)}
    assert tuple(jdbc.orphans(spark, database, ("child", "parent"), ("parent", "id")).first()) == (2, 1)


def test_options():
    oracle = {"type": "oracle", "host": "h", "service_name": "s", "schema": "app", "timeout": 30}
    assert jdbc.options(oracle)["sessionInitStatement"].endswith("CURRENT_SCHEMA = app") and jdbc.options(oracle)["queryTimeout"] == "30"
    assert jdbc.jdbc_url({"type": "db2", "host": "h", "database": "d", "ssl": True}) == "jdbc:db2://h:50000/d:sslConnection=true;"


def test_catalog_export(spark, tmp_path):
    table = {
        "name": "claims", "profile": {"rowCount": 200},
        "columns": [
            {"name": "ID", "dataType": "INT", "profile": {"nullProportion": 0.0, "distinctCount": 200, "mean": 100.5, "min": "1", "max": "200", "histogram": {"boundaries": ["1-100", "101-200"], "frequencies": [100, 100]}}},
            {"name": "Note", "dataType": "VARCHAR", "profile": {"nullProportion": 0.125, "uniqueCount": 3, "minLength": 2, "maxLength": 9}},
            {"name": "raw", "dataType": "BLOB"},
        ],
        "lineage": {"edges": [
            {"fromEntity": "db.claims", "toEntity": "db.mart_claims", "columns": [{"fromColumns": ["db.claims.ID", "db.claims.Note"], "toColumn": "db.mart_claims.key"}]},
            {"fromEntity": "db.claims", "toEntity": "db.report"},
        ]},
    }
    (tmp_path / "tables.json").write_text(json.dumps(table) + "\n" + json.dumps({"name": "bare"}) + "\n")
    (tmp_path / "terms.json").write_text(json.dumps({"name": "Claim", "displayName": "A Claim", "description": "d", "relatedTerms": [{"name": "Payment"}]}) + "\n" + json.dumps({"name": "bare"}))
    path = str(tmp_path / "tables.json")
    profile = {r.column_name: r for r in discovery.read_catalog_profile(spark, path).collect()}
    assert set(profile) == {"id", "note"} and profile["id"].histogram[1].n == 100 and profile["id"].row_count == 200
    assert (profile["note"].null_percent, profile["note"].distinct_count, profile["note"].max_length) == (12.5, 3, 9)
    edges = {tuple(r) for r in discovery.read_catalog_lineage(spark, path).collect()}
    assert edges == {("claims", "id", "mart_claims", "key"), ("claims", "note", "mart_claims", "key"), ("claims", None, "report", None)}
    terms = {r.term: r for r in discovery.read_catalog_glossary(spark, str(tmp_path / "terms.json")).collect()}
    assert terms["claim"].related == ["Payment"] and terms["bare"].display_name == "bare" and terms["bare"].synonyms == []
