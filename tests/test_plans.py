"""Edge cases of operators, plans and streams."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from migcheck.operators import checksum, comparing, governance, keys, profile, schema
from migcheck.plans import loading, monitor, scoring
from migcheck.sources.shared import shared_dir
from migcheck.streaming import events


def test_null_keys_count_in_one_orphan_check_only(spark):
    child = spark.createDataFrame([(1,), (2,), (None,), (2,)], "fk int")
    parent = spark.createDataFrame([(1,), (3,)], "pk int")
    assert tuple(keys.orphan_count(child, "fk", parent, "pk").first()) == (3, 1, 3)
    assert [r.key for r in keys.orphan_keys(child, "fk", parent, "pk").collect()] == [2]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "a int, b string")
    assert {r.column_name: r.null_percent for r in profile.null_percentages(none).collect()} == {"a": 0.0, "b": 0.0}
    assert profile.column_profile(none).count() == 0
    assert comparing.row_count(none, none).first().status == "PASS"
    assert comparing.sample_compare(none, none, ("a", "a"), [("b", "b")]).first().status == "WARN"
    assert checksum.row_checksum(none, ["a", "b"]).first().n == 0
    assert monitor.freshness(none.withColumn("ts", F.lit(None).cast("timestamp")), "ts", "2026-01-01 00:00:00", 1).first().stale


def test_checksums_ignore_order_but_not_values(spark):
    one = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "k int, v string")
    two = one.orderBy(F.desc("k")).repartition(3)
    assert checksum.column_checksums(one, ["k", "v"]).orderBy("column_name").collect() == checksum.column_checksums(two, ["k", "v"]).orderBy("column_name").collect()
    changed = one.withColumn("v", F.coalesce("v", F.lit("x")))
    assert checksum.row_checksum(one, ["k", "v"]).first() != checksum.row_checksum(changed, ["k", "v"]).first()
    with pytest.raises(ValueError, match="over 2 rows"):
        checksum.ordered_md5(one, "k", most_rows=2)


def test_row_checksums_tell_separators_and_null_texts_apart(spark):
    rows = [("a|b", "c"), ("a", "b|c"), ("a\\", "|c"), ("a\\|", "c"), (None, "c"), ("NULL", "c"), ("\\N", "c"), ("", "c")]
    found = {checksum.row_checksum(spark.createDataFrame([r], "a string, b string"), ["a", "b"]).first().checksum for r in rows}
    assert len(found) == len(rows)


def test_streamed_md5_takes_any_number_of_rows(spark):
    import hashlib

    text = "".join(str(i // 2) for i in range(1_000_100))
    many = spark.range(1_000_100).selectExpr("id div 2 AS k").orderBy(F.rand(1))
    assert checksum.streamed_md5(many, "k").first().checksum == hashlib.md5(text.encode()).hexdigest()
    assert checksum.streamed_md5(many.limit(0), "k").first().checksum == checksum.ordered_md5(many.limit(0), "k").first().checksum


def test_schema_names(spark):
    df = spark.sql("SELECT 1 AS a, cast(1 AS decimal(5,2)) AS b, 'x' AS c, array(1) AS d, date'2020-01-01' AS e")
    assert [r.data_type for r in schema.schema_of(spark, df).orderBy("position").collect()] == ["integer", "numeric(5,2)", "varchar", "array<int>", "date"]


def test_load_order_refuses_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a")], "child string, parent string")
    with pytest.raises(ValueError, match="cycle"):
        loading.load_order(edges, spark.createDataFrame([("a",), ("b",)], "table string"), most_levels=4)


def test_loads_go_on_after_a_failure(spark):
    bad = spark.range(1).select(F.raise_error(F.lit("broken")).alias("x"))
    steps = [("a", bad, shared_dir(spark, "a")), ("b", spark.range(3).toDF("id"), shared_dir(spark, "b")), ("c", bad, "never")]
    state = loading.run_loads(steps, {"c"})
    assert state["a"].startswith("failed") and state["b"] == "completed: 3 rows" and state["c"] == "completed"


def test_scores(spark):
    df = spark.createDataFrame([(89.99,), (90.0,), (69.9,)], "s double").select(scoring.traffic_light(F.col("s")).alias("l"))
    assert [r.l for r in df.collect()] == ["YELLOW", "GREEN", "RED"]
    score = governance.governance_score(*(F.lit(n) for n in (10, 20, 9, 5, 9)))
    assert spark.range(1).select(score.alias("s")).first().s == 100 - 30 - 10 - 10 - 30 - 15


def test_stream_equals_batch(spark, sf_dir):
    batch = spark.read.parquet(f"{sf_dir}/events.parquet")
    source = shared_dir(spark, "events-in")
    batch.repartition(3).write.parquet(source)
    stream = spark.readStream.schema(batch.schema).parquet(source)
    name = "counts"
    query = events.tumbling_counts(stream, watermark="3650 days").writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(map(tuple, spark.table(name).collect())) == sorted(map(tuple, events.tumbling_counts(batch).collect()))
    out = shared_dir(spark, "watch")
    events.watch(stream, 10, out, shared_dir(spark, "watch-state")).awaitTermination(120)
    checks = spark.read.parquet(out)
    assert checks.agg(F.sum("n_rows")).first()[0] == batch.count() and checks.first().is_anomaly
    assert events.deduplicated(batch.union(batch), ["event_id"]).count() == batch.select("event_id").distinct().count()


def test_stream_is_held_against_its_baseline(spark, tmp_path):
    from migcheck.plans import observer

    before = spark.range(100).selectExpr("id", "id % 3 AS kind", "'x' AS gone")
    observer.save_baseline({"rows": before}, str(tmp_path / "base"))
    spark.range(10).selectExpr("id", "id % 3 AS kind", "timestamp'2025-12-31 12:00:00' AS updated_at").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, kind long, updated_at timestamp").parquet(str(tmp_path / "in"))
    seen = []
    query = events.observe_stream(
        stream, "rows", observer.load_baseline(spark, str(tmp_path / "base")), str(tmp_path / "alerts"), str(tmp_path / "state"), now="2026-01-01 00:00:00", callbacks=[lambda check, row: seen.append((check, row["detail"]))]
    )
    query.awaitTermination(120)
    assert seen == [("schema_drift", "added:updated_at,dropped:gone")]  # a batch's volume is none of a whole table's
    assert spark.read.json(str(tmp_path / "alerts")).count() == 1
    later = events.observe_stream(stream, "rows", observer.load_baseline(spark, str(tmp_path / "base")), str(tmp_path / "again"), str(tmp_path / "other"))
    later.awaitTermination(120)  # at the batch's own time the rows are stale
    assert {r.check for r in spark.read.json(str(tmp_path / "again")).collect()} == {"schema_drift", "freshness"}
