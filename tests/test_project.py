"""A project validated from end to end."""

from __future__ import annotations

import json

import pytest
from pyspark.errors import AnalysisException

from migcheck import project
from migcheck.__main__ import main
from migcheck.plans.runs import run_status
from migcheck.plugins import Plugins
from migcheck.queries.common import modern_orders


@pytest.fixture(scope="module")
def config(spark, sf_dir, tmp_path_factory):
    folder = tmp_path_factory.mktemp("project")
    modern_orders(spark.read.parquet(f"{sf_dir}/orders.parquet")).write.parquet(str(folder / "modern"))
    maps = {"o_orderkey": "order_id", "o_custkey": "customer_id", "o_orderstatus": "order_status", "o_totalprice": "total_price", "o_orderdate": "ordered_at"}
    own = {
        "connections": {"files": {"type": "parquet"}},
        "datasets": {
            "orders": {
                "legacy": {"connection": "files", "path": f"{sf_dir}/orders.parquet"},
                "modern": {"connection": "files", "path": "${MODERN_PATH:" + str(folder / "modern") + "}"},
                "key": {"legacy": "o_orderkey", "modern": "order_id"},
                "mappings": [{"source": s, "target": t} for s, t in maps.items()] + [{"source": "o_orderpriority", "type": "archived"}],
                "rules": {"negative": "o_totalprice < 0"},
                "not_null": ["o_orderkey"],
                "references": [{"column": "customer_id", "parent": {"connection": "files", "path": f"{sf_dir}/customer.parquet", "column": "c_custkey"}}],
                "aggregates": [
                    {"name": "rows", "legacy": "SELECT count(*) AS n FROM legacy", "modern": "SELECT count(*) AS n FROM modern"},
                    {"name": "kinds", "legacy": "SELECT DISTINCT o_orderstatus AS s FROM legacy", "modern": "SELECT DISTINCT upper(order_status) AS s FROM modern"},
                    {"name": "broken", "legacy": "SELECT nothing FROM legacy", "modern": "SELECT 1"},
                ],
            }
        },
    }
    path = folder / "project.json"
    path.write_text(json.dumps(own))
    return str(path), folder


def test_pre_phase(spark, config):
    run = project.validate(spark, project.load_config(config[0]), "orders", "pre")
    by = {r["name"]: r for r in run["results"]}
    assert by["schema_diff"]["penalty"] == 1 and by["data_quality"]["status"] == "PASS" and by["profile_risk"]["status"] == "PASS"
    assert run["score"] > 90 and run["status"] == "GREEN"


def test_post_phase(spark, config):
    plugins = Plugins(score_adjusters=[lambda phase, score, results: None], validators={"pre": [], "post": [lambda *a: project.Result("own", "PASS", 0.5)]})
    run = project.validate(spark, project.load_config(config[0]), "orders", "post", plugins)
    by = {r["name"]: r for r in run["results"]}
    assert by["row_count"]["status"] == "FAIL" and by["checksums"]["status"] == "WARN" and by["own"]["penalty"] == 0.5
    assert {a["name"] for a in by["aggregates"]["details"]["aggregates"]} == {"rows", "broken"}
    assert by["archived_leakage"]["status"] == "PASS" and by["unmapped_columns"]["status"] == "PASS"
    assert by["sample_compare"]["details"]["sampled"] == 100
    assert run["score"] == round(100 - sum(r["penalty"] for r in run["results"]), 2)


def test_command_line_and_history(spark, config):
    path, folder = config
    assert main(["validate", path, "orders", "--phase", "pre", "--runs", str(folder / "runs")]) == 0
    runs = run_status(project.read_runs(spark, str(folder / "runs"))).collect()
    assert [(r.dataset, r.phase) for r in runs] == [("orders", "pre")]
    assert main(["status", "--runs", str(folder / "runs")]) == 0
    assert main(["profile", path, "orders"]) == 0


def test_further_checks(spark, config):
    own = project.load_config(config[0])
    files = own["datasets"]["orders"]
    files |= {"types": {"o_orderkey": "int"}, "unique": ["o_orderkey"], "transform_script": "SELECT o_orderkey AS order_id FROM legacy"}
    files["mappings"].append({"source": "o_clerk", "target": "clerk_hash", "type": "transform", "rationale": "hash"})
    by = {r["name"]: r for r in project.validate(spark, own, "orders", "pre")["results"]}
    assert by["frame_schema"]["status"] == "PASS" and by["frame_schema"]["penalty"] == 0
    assert by["etl_tests"]["penalty"] == 4 and {i["test"] for i in by["etl_tests"]["details"]["issues"]} == {"transform_source_missing", "pii_hash_missing"}


def test_children_and_references_that_fail(spark, config, sf_dir):
    own = project.load_config(config[0])
    lines = {"connection": "files", "path": f"{sf_dir}/lineitem.parquet", "column": "l_orderkey"}
    lost = {"connection": "files", "path": "/nowhere.parquet", "column": "x"}
    own["datasets"]["orders"] |= {"children": [lines], "references": []}
    d = project.Dataset.open(spark, own, "orders")
    orphans = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_orderkey % 97 = 0").select("l_orderkey").distinct().count()
    assert orphans and project.check_references(d).details["checks"] == [{"column": "l_orderkey", "orphans": orphans}]
    assert project.check_normalization(d).penalty == 10
    d.config["references"] = [{"column": "customer_id", "parent": lost}]
    bad = project.check_references(d)
    assert bad.status == "WARN" and bad.penalty == 0 and "error" in bad.details["checks"][0]


def test_loads_resume_where_they_failed(spark, tmp_path):
    from migcheck.plans import loading

    good, bad = spark.range(3), spark.range(2).selectExpr("raise_error('broken') AS id")
    state = str(tmp_path / "state")
    assert loading.load_state(spark, state).count() == 0
    first = loading.resume_loads([("a", good, str(tmp_path / "a")), ("b", bad, str(tmp_path / "b"))], state)
    assert first == {"a": "completed", "b": "failed"}
    # a is not loaded again: its frame would fail now
    assert loading.resume_loads([("a", bad, str(tmp_path / "a")), ("b", good, str(tmp_path / "b"))], state) == {"a": "completed", "b": "completed"}
    assert {(r["table"], r["status"], r["rows"]) for r in loading.load_state(spark, state).collect()} == {("a", "completed", 3), ("b", "completed", 3)}


def test_observation_and_ingestion_by_command(spark, config):
    path, folder = config
    assert main(["ingest", path, "--target", str(folder / "loaded")]) == 0
    assert spark.read.parquet(str(folder / "loaded" / "orders")).count() > 0
    watch = ["observe", path, "--baseline", str(folder / "base"), "--alerts", str(folder / "alerts"), "--now", "2026-01-01 00:00:00"]
    with pytest.raises(AnalysisException):
        main(watch)  # no baseline was set
    assert main([*watch, "--set-baseline"]) == 0 and main(watch) == 0  # nothing changed since the baseline
    assert main(["prove", "--runs", str(folder / "runs")]) == 0


def test_signoffs_are_kept(spark, tmp_path):
    from migcheck.plans import runs

    path = str(tmp_path / "log")
    runs.append_signoff(spark, path, "2026-01-01", "orders", "pre", "a|b", True)
    runs.append_signoff(spark, path, "2026-01-02", "parts", "pre", "c", False)
    signed = runs.read_signoffs(spark.read.text(path).toDF("line"))
    assert {(r.dataset, r.who, r.approved) for r in signed.collect()} == {("orders", "a b", True), ("parts", "c", False)}
    known = spark.createDataFrame([("orders",), ("parts",), ("orders",)], "dataset string")
    assert {tuple(r) for r in runs.signoff_gate(known, signed).collect()} == {("orders", True), ("parts", False)}


def test_boolean_columns(spark):
    from migcheck.operators import transforms

    df = spark.createDataFrame([("y", "a", None, True), ("N", "T", None, False), (None, "F", None, None)], "a string, b string, c string, d boolean")
    assert {r.column_name for r in transforms.boolean_columns(df).collect()} == {"a", "c", "d"}
    assert transforms.boolean_columns(df.limit(0)).count() == 0


def test_extension_points(spark, config, tmp_path):
    from pyspark.sql import functions as F

    own, drifted, loaded = project.load_config(config[0]), [], []

    def too_many(spark, name, df):
        n = df.agg(F.count("*").alias("n"))
        return n.select(F.lit("too_many").alias("check"), F.lit(name).alias("table"), F.lit("LOW").alias("severity"), (F.col("n") > 1).alias("alert"), F.col("n").cast("string").alias("detail"))

    plugins = Plugins(on_drift=[lambda check, row: drifted.append(check)], observer_checks=[too_many], post_ingest=[lambda *a: loaded.append(a)], report_sections=[lambda run: ["## Own", run["dataset"]]])
    args = (spark, own, str(tmp_path / "base"), "2026-01-01 00:00:00", str(tmp_path / "alerts"), plugins)
    assert project.observe(*args, set_baseline=True) == 0 and project.observe(*args) == 1 and drifted == ["too_many"]
    assert project.ingest(spark, own, str(tmp_path / "loaded"), plugins) == {"orders": "completed"} and loaded == [("orders", "completed")]
    path = project.write_report({"dataset": "orders", "phase": "pre", "score": 1.0, "status": "RED", "results": []}, str(tmp_path), plugins)
    with open(f"{path}/report.md") as file:
        assert file.read().endswith("## Own\norders\n")
