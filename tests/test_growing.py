"""Streams against batches, incremental loads against full ones, groups found in flat tables."""

from __future__ import annotations

import datetime
import os
import random

import pytest
from pyspark.sql import functions as F

from migcheck import project
from migcheck.operators import repeated
from migcheck.sources.incremental import incremental_load, read_mark
from migcheck.streaming import monitor

START = datetime.datetime(2026, 1, 1)


@pytest.fixture
def store(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, monitor.STORE)
    yield
    spark.conf.unset(name)


def events_of(spark, seed=3):
    rng = random.Random(seed)
    rows, at = [], START
    for i in range(300):
        at += datetime.timedelta(minutes=rng.choice([1, 5, 30, 90]))
        jitter = datetime.timedelta(minutes=rng.randint(0, 50))  # arrives out of order, within the delay
        rows.append((i, rng.choice("abcd"), at + jitter))
    return rows, spark.createDataFrame([*rows, (999, None, at), (998, "a", None)], "id long, who string, ts timestamp")


def test_silences_of_a_stream_equal_the_batch(spark, tmp_path, store):
    rows, batch = events_of(spark)
    expected = {tuple(r) for r in monitor.silences(batch, "who", 3 * 3600).collect()}
    end = max(at for _, _, at in rows) - datetime.timedelta(hours=2)
    by_hand = set()
    for who in "abcd":
        times = sorted(at for _, w, at in rows if w == who)
        by_hand |= {(who, a) for a, b in zip(times, [*times[1:], end]) if min(b, end) - a > datetime.timedelta(hours=3)}
    assert expected == by_hand and len(expected) > 10
    for part in range(4):  # each part is a run of its own on the same checkpoint
        low, high = 75 * part, 75 * (part + 1)
        batch.where((F.col("id") >= low) & (F.col("id") < high) | (F.col("id") > 900) & F.lit(part == 3)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        found = monitor.silences(spark.readStream.schema(batch.schema).parquet(f"{tmp_path}/in"), "who", 3 * 3600)
        monitor.append_once(found, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination(300)
    got = [(r.key, r.since) for r in spark.read.schema(found.schema).parquet(f"{tmp_path}/out").select("key", "since").collect()]
    assert sorted(got) == sorted(expected)  # once each


def test_seasonal_volumes(spark):
    hours = [(h, n) for day in range(5) for h, n in ((day * 24 + 9, 10), (day * 24 + 10, 2))] + [(5 * 24 + 9, 10), (5 * 24 + 10, 10), (5 * 24 + 11, 1)]
    rows = [("x", START + datetime.timedelta(hours=h, seconds=i)) for h, n in hours for i in range(n)]
    events = spark.createDataFrame(rows, "who string, ts timestamp")
    usual = monitor.seasonal_baseline(events.where(F.col("ts") < START + datetime.timedelta(days=5)), "who")
    got = {(r.window_start, r.n, r.usual, r.deviation) for r in monitor.volume_alerts(events, usual, "who").collect()}
    day = START + datetime.timedelta(days=5)
    assert got == {(day + datetime.timedelta(hours=10), 10, 2.0, 4.0), (day + datetime.timedelta(hours=11), 1, None, 1.0)}


def files(path):
    return {(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_incremental_loads_rewrite_only_what_changed(spark, tmp_path):
    day = lambda n: datetime.datetime(2026, 1, n)
    schema = "id long, v string, at timestamp_ntz, part int"
    load = lambda rows: incremental_load(spark.createDataFrame(rows, schema), f"file://{tmp_path}/t", "id", "at", "part")
    assert load([(i, "first", day(1), i % 4) for i in range(40)] + [(0, "older", day(1) - datetime.timedelta(hours=1), 3), (None, "x", day(1), 0), (77, "x", None, 1)]) == {"changes": 40, "partitions": 4}
    before = files(tmp_path / "t" / "data")
    assert load([(4, "moved", day(3), 1), (5, "new", day(3), 1), (5, "newer", day(4), 1), (100, "added", day(3), 1)]) == {"changes": 3, "partitions": 2}
    after = files(tmp_path / "t" / "data")
    same = {d for (d, f) in before if (d, f) in after and before[d, f] == after[d, f]}
    assert {os.path.basename(d) for d in same} == {"part=2", "part=3"}
    # late: within a day of the mark and newer than what is there; out of date; too late
    assert load([(6, "late", day(3) + datetime.timedelta(hours=1), 2), (5, "old", day(3) + datetime.timedelta(hours=1), 1), (7, "lost", day(2), 3)]) == {"changes": 1, "partitions": 1}
    assert read_mark(spark, f"file://{tmp_path}/t") == day(4)
    got = {r.id: (r.v, r.part) for r in spark.read.parquet(f"{tmp_path}/t/data").collect()}
    assert len(got) == 41 and got[4] == ("moved", 1) and got[5] == ("newer", 1) and got[6] == ("late", 2) and got[7] == ("first", 3) and got[100] == ("added", 1) and got[0] == ("first", 0)
    # the last rows of a partition leave it
    load([(i, "gone", day(5), 0) for i in range(40) if i % 4 == 3])
    assert not any("part=3" in d for d, _ in files(tmp_path / "t" / "data")) and spark.read.parquet(f"{tmp_path}/t/data").count() == 41
    assert load([]) == {"changes": 0, "partitions": 0}


def test_groups_by_number_and_by_domain(spark):
    rows = [(i, f"s{i % 5}", "c" if i % 2 else None, f"s{(i + 1) % 5}", f"n{i}", ["x", "y", "z"][i % 3], ["x", "y", "z"][(i + 1) % 3], i % 2, "ssn") for i in range(60)]
    names = "id long, addr1_street string, addr1_city string, addr_2_street string, note string, home_state string, work_state string, flag int, ssn string"
    df = spark.createDataFrame(rows, names)
    found = repeated.repeated_groups(df)
    assert found == {
        "addr": {"1": {"street": "addr1_street", "city": "addr1_city"}, "2": {"street": "addr_2_street"}},
        "state": {"home": {"value": "home_state"}, "work": {"value": "work_state"}},
    }
    got = repeated.as_rows(df, "id", found["addr"]).where("id = 1")
    assert {tuple(r) for r in got.collect()} == {(1, "1", "s1", "c"), (1, "2", "s2", None)}
    assert repeated.as_rows(df, "id", found["state"]).count() == 120
    assert repeated.lookup_columns(df) == ["addr1_street", "addr_2_street", "home_state", "work_state"]
    assert repeated.personal_columns(df) == ["ssn"]
    assert repeated.repeated_groups(df.select("id", "note")) == {}


def test_references_derived_from_the_data(spark, tmp_path):
    spark.createDataFrame([(i,) for i in range(20)], "key long").write.parquet(str(tmp_path / "parents"))
    spark.createDataFrame([(100 + i, i if i < 19 else 77) for i in range(20)], "id long, parent long").write.parquet(str(tmp_path / "children"))
    source = lambda name: {"connection": "files", "path": str(tmp_path / name)}
    config = {
        "connections": {"files": {"type": "parquet"}},
        "datasets": {"children": {"legacy": source("children"), "modern": source("children"), "references": "derive", "tables": {"parents": source("parents")}}},
    }
    d = project.Dataset.open(spark, config, "children")
    found = project.check_references(d)
    assert found.status == "FAIL" and {"column": "children.parent", "parent": "parents.key", "orphans": 1} in found.details["checks"]
