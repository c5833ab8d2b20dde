"""Discovery, enrichment, rationalisation and load strategies of a project, by its commands."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from migcheck import metadata, project
from migcheck.__main__ import main
from migcheck.plugins import Plugins


@pytest.fixture(scope="module")
def own(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("metadata")
    rows = [(i, f"name {i}", f"{i:09d}", ["A", "B", "C"][i % 3], i // 2) for i in range(40)]
    spark.createDataFrame(rows, "cl_recid long, cl_fnam string, cl_ssn string, cl_stat string, cl_emplr long").write.parquet(f"{folder}/legacy")
    spark.createDataFrame([(i, f"name {i}", i // 2) for i in range(40)], "claimant_id long, first_name string, employer_id long").write.parquet(f"{folder}/modern")
    spark.createDataFrame([(i, f"firm {i}") for i in range(30)], "em_recid long, em_nm string").write.parquet(f"{folder}/firms")
    spark.createDataFrame([(i, f"firm {i}") for i in range(30)], "employer_id long, name string").write.parquet(f"{folder}/new_firms")
    files = lambda name: {"connection": "files", "path": f"{folder}/{name}"}
    config = {
        "connections": {"files": {"type": "parquet"}},
        "datasets": {
            "claimants": {"legacy": files("legacy"), "modern": files("modern"), "mappings": [{"source": "cl_stat", "target": "status_code"}], "usage": {"query_count": 1000, "age_days": 3, "tier_score": 100}},
            "employers": {"legacy": files("firms"), "modern": files("new_firms"), "strategy": "external"},
        },
    }
    (folder / "project.json").write_text(json.dumps(config))
    table = {
        "name": "claimants",
        "columns": [{"name": "CL_STAT", "dataType": "CHAR", "description": "State of the claim", "tags": [{"tagFQN": "PII.Sensitive"}], "ordinalPosition": 1}],
        "lineage": {"edges": [{"fromEntity": "db.claimants", "toEntity": "db.a"}, {"fromEntity": "db.claimants", "toEntity": "db.b"}]},
    }
    (folder / "catalog.json").write_text(json.dumps(table))
    (folder / "terms.json").write_text(json.dumps({"name": "cl_stat", "displayName": "Status"}))
    return folder


def test_discover_and_enrich(spark, own):
    assert main(["discover", str(own / "project.json"), "--metadata", str(own / "meta")]) == 0
    maps = {(r.table, r.source): (r.target, r.type) for r in spark.read.json(str(own / "meta" / "mappings")).collect()}
    assert maps["claimants", "cl_stat"] == ("status_code", "rename") and maps["claimants", "cl_ssn"] == ("ssn_hash", "transform")
    assert maps["claimants", "cl_fnam"] == ("first_name", "rename")
    found = {(r.child_table, r.child_column, r.parent_table) for r in spark.read.json(str(own / "meta" / "references")).collect()}
    assert ("claimants", "employer_id", "employers") in found
    plan = {(r.table, r.role) for r in spark.read.json(str(own / "meta" / "plan")).collect()}
    assert ("claimants", "primary") in plan and ("claimants", "lookup") in plan and ("employers", "primary") in plan
    assert main(["enrich", str(own / "catalog.json"), "--metadata", str(own / "meta"), "--terms", str(own / "terms.json")]) == 0
    got = {r.name: r for r in spark.read.json(str(own / "meta" / "enriched")).collect()}
    assert (got["cl_stat"].description, got["cl_stat"].confidence, got["cl_stat"].pii, got["cl_stat"].term) == ("State of the claim", 1.0, True, "Status")
    assert got["cl_ssn"].pii and got["cl_fnam"].confidence < 1


def test_rationalize(spark, own):
    assert main(["rationalize", str(own / "project.json"), "--metadata", str(own / "meta"), "--catalog", str(own / "catalog.json")]) == 0
    got = {r.table: (r.score, r.recommendation) for r in spark.read.json(str(own / "meta" / "scope")).collect()}
    assert got["claimants"] == (round(0.35 * 95 + 0.25 * 55 + 0.2 * 100 + 10 + 10, 2), "migrate") and got["employers"][1] in ("review", "archive")


def test_plugins_and_strategies(spark, own, capsys):
    config = project.load_config(str(own / "project.json"))
    plugins = Plugins(
        glossary_enrichers=[lambda glossary: glossary.withColumn("system", F.lit("host"))],
        normalization_overrides={"employers": lambda plan: plan.withColumn("entity", F.lit("firm"))},
        rationalization_overrides={"claimants": "archive"},
        ingest_strategies={"claimants": "incremental"},
    )
    out = metadata.discover(spark, config, str(own / "meta2"), plugins)
    assert {r.system for r in out["glossary"].collect()} == {"host"} and {r.entity for r in out["plan"].where("table = 'employers'").collect()} == {"firm"}
    assert {r.table: r.recommendation for r in metadata.rationalize(spark, config, str(own / "meta2"), None, plugins).collect()}["claimants"] == "archive"
    assert main(["ingest", str(own / "project.json"), "--target", str(own / "loaded"), "--plan-only"]) == 0
    assert "[('claimants', 'full_load'), ('employers', 'external')]" in capsys.readouterr().out
    assert project.ingest(spark, config, str(own / "loaded")) == {"claimants": "completed", "employers": "external"}
    config["datasets"]["claimants"] |= {"key": {"legacy": "cl_recid", "modern": "claimant_id"}, "incremental": {"changed_at": "at", "partition": "cl_stat"}}
    with pytest.raises(ValueError):
        project.ingest_plan(config, Plugins(ingest_strategies={"claimants": "magic"}))
    assert project.ingest_plan(config, plugins)[0] == ("claimants", "incremental")


def test_governance_as_csv(spark, tmp_path):
    run = {"results": [{"name": "governance", "details": {"score": 3, "nulls": [{"column_name": "a", "null_percent": 30.0}]}}, {"name": "unmapped_columns", "details": {"columns": ["b"]}}, {"name": "row_count", "details": {"x": [1]}}]}
    metadata.write_governance(run, spark, str(tmp_path / "out"))
    got = {(r.check, r.kind, r.item) for r in spark.read.csv(str(tmp_path / "out"), header=True).collect()}
    assert got == {("governance", "nulls", "a"), ("unmapped_columns", "columns", "b")}


def test_sketches_of_a_baseline_tell_drift(spark, tmp_path):
    spark.range(5000).selectExpr("id", "id % 10 AS kind").write.parquet(str(tmp_path / "t"))
    files = {"connection": "files", "path": str(tmp_path / "t")}
    config = {"connections": {"files": {"type": "parquet"}}, "datasets": {"t": {"legacy": files, "modern": files}}, "sketches": True}
    args = (spark, config, str(tmp_path / "base"), "2026-01-01 00:00:00", str(tmp_path / "alerts"))
    assert project.observe(*args, set_baseline=True) == 0 and project.observe(*args) == 0
    spark.range(5000, 10000).selectExpr("id", "id % 40 AS kind").write.mode("overwrite").parquet(str(tmp_path / "t"))
    spark.catalog.refreshByPath(str(tmp_path / "t"))
    assert project.observe(*args) == 3
    told = {":".join(r.detail.split(":")[:2]) for r in spark.read.json(str(tmp_path / "alerts")).collect()}
    assert told == {"quantile:id", "distinct:kind", "quantile:kind"}
