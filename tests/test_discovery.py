"""Folder scans, layout fit, catalogs, mappings."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from migcheck.operators import mapping
from migcheck.queries.common import literal
from migcheck.sources import copybook, discovery

LAYOUT = "       01 CUST-REC.\n           05 CUST-KEY PIC 9(4).\n           05 CUST-NAME PIC X(6).\n"


def test_scan_and_pair(spark, tmp_path):
    for name, text in {"cpy/CUST.cpy": LAYOUT, "in/cust.dat": "0001abcdef", "in/x.csv": "a,b", "data/list.txt": "x", "notes.txt": "y", ".hidden.sql": "z", "a.sql": "q"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    files = discovery.scan_folder(spark, str(tmp_path))
    assert sorted((r.kind, r.stem) for r in files.collect()) == [("copybook", "CUST"), ("csv", "X"), ("datafile", "CUST"), ("datafile", "LIST"), ("sql", "A")]
    pair = discovery.pair_by_stem(files).collect()
    assert len(pair) == 1 and pair[0].layout.endswith("CUST.cpy") and pair[0].data.endswith("cust.dat")


def test_layout_fit(spark):
    fields = copybook.parse(LAYOUT)
    records = {b"0001abcdef": 100.0, b"abcdabcdef": 50.0, b"          ": 0.0, "0001ABC   ".encode("cp037"): 100.0, b"0001\x01\x02    ": 50.0}
    for record, fit in records.items():
        df = spark.createDataFrame([(bytearray(record),)], "record binary")
        assert discovery.layout_fit(df, fields).first().fit == fit


def test_table_names(spark):
    df = spark.createDataFrame([("CUST-REC",), ("acctdata",), ("PAYMENT-RECORD",), ("WS_CLAIMS",), ("data",)], "n string")
    assert [r.t for r in df.select(discovery.table_name(F.col("n")).alias("t")).collect()] == ["customers", "accounts", "payments", "claims", "data"]


def test_catalog_and_alerts(spark, tmp_path):
    entry = {"name": "claims", "columns": [{"name": "ID", "dataType": "INT", "ordinalPosition": 1, "tags": [{"tagFQN": "PII.None"}]}, {"name": "N", "dataType": "TEXT"}]}
    (tmp_path / "catalog.json").write_text(json.dumps(entry) + "\n")
    rows = discovery.read_catalog(spark, str(tmp_path / "catalog.json")).orderBy("column_name").collect()
    assert [(r.table, r.column_name, r.data_type, r.tags) for r in rows] == [("claims", "id", "int", ["PII.None"]), ("claims", "n", "text", None)]
    for _ in range(2):
        discovery.append_alerts(spark.createDataFrame([("claims", "HIGH")], "table string, severity string"), str(tmp_path / "alerts"))
    assert spark.read.json(str(tmp_path / "alerts")).count() == 2


def test_build_mappings(spark):
    overrides = spark.createDataFrame([("claims", "cm_wkamt", "weekly_amount", "transform")], "table string, source string, target string, type string")
    built = mapping.build_mappings(literal(spark, "names"), literal(spark, "modern_names"), overrides)
    got = {(r.table, r.source): (r.target, r.type, r.confidence) for r in built.collect()}
    assert len(got) == literal(spark, "names").count()
    assert got["claims", "cm_wkamt"] == ("weekly_amount", "transform", 1.0)
    assert got["claimants", "cl_fil1"][:2] == (None, "removed") and got["claimants", "cl_bact"][:2] == (None, "archived")
    assert got["claimants", "cl_ssn"] == ("ssn_hash", "transform", 0.9)
    assert got["claimants", "cl_lnam"] == ("last_name", "rename", 0.95)
    assert got["payments", "bad name!"][1] == "pending"
    edited = mapping.set_target(built, spark.createDataFrame([("payments", "bad name!", "good_name"), ("claimants", "cl_lnam", "last_name")], "table string, source string, target string"))
    after = {(r.table, r.source): (r.target, r.confidence) for r in edited.collect()}
    assert after["payments", "bad name!"] == ("good_name", 1.0) and after["claimants", "cl_lnam"] == ("last_name", 0.95)


def test_glossary(spark):
    got = {r.name: (r.pii, r.description, r.confidence) for r in mapping.glossary(literal(spark, "names")).collect()}
    assert got["cl_ssn"][0] and got["email_address"] == (True, "Email address for email_address", 0.8)
    assert got["cl_fnam"] == (False, "Char value for cl_fnam", 0.3)
