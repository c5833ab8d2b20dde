"""Streams and loads that go on: silences, seasonal volumes, incremental loads; repeated groups of flat tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from migcheck.operators import repeated
from migcheck.queries.common import Registry, table
from migcheck.sources.incremental import incremental_load as load
from migcheck.sources.shared import shared_dir
from migcheck.streaming import monitor

R = Registry()

_MOST = 4 * 3600

_SILENCES = f"""WITH e AS (SELECT user_id AS key, epoch_us(ts) // 1000 AS ms FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
    n AS (SELECT key, ms, least(lead(ms) OVER (PARTITION BY key ORDER BY ms), (SELECT max(ms) FROM e) - 7200000) AS next FROM e)
    SELECT key, make_timestamp(ms * 1000) AS since FROM n WHERE next - ms > {_MOST * 1000}"""


def _plain(found):
    return found.select("key", F.col("since").cast("timestamp_ntz").alias("since"))


@R.add("silences", _SILENCES)
def silences(spark, sf_dir):
    return _plain(monitor.silences(table(spark, sf_dir, "events"), "user_id", _MOST))


def _replayed(spark, sf_dir, watched, name):
    """Events that arrive in three parts, and what ``watched`` makes of the stream; it is stopped and goes on after each part."""
    path = shared_dir(spark, name)
    events = table(spark, sf_dir, "events")
    first, last = events.agg(F.min("ts"), F.max("ts")).first()
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", monitor.STORE)
    try:
        for i in range(3):
            step = (last - first) / 3
            low, high = F.lit(first + i * step).cast("timestamp_ntz"), F.lit(first + (i + 1) * step).cast("timestamp_ntz")
            part = events.where((F.col("ts") >= low) & ((F.col("ts") < high) | F.lit(i == 2)))
            part.write.mode("append").parquet(f"{path}/events")
            rows = watched(spark.readStream.schema(events.schema).parquet(f"{path}/events"))
            monitor.append_once(rows, f"{path}/rows", f"{path}/checkpoint").awaitTermination()
    finally:
        if before:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
        else:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    return spark.read.schema(rows.schema).parquet(f"{path}/rows").select(*rows.columns)


@R.add("stream_silences", _SILENCES)
def stream_silences(spark, sf_dir):
    """The silences of a stream, by state and timers."""
    return _plain(_replayed(spark, sf_dir, lambda events: monitor.silences(events, "user_id", _MOST), "silences"))


_VOLUMES = """WITH w AS (SELECT event_type, date_trunc('hour', ts) AS window_start, hour(ts) AS season, count(*) AS n FROM events GROUP BY ALL),
    b AS (SELECT event_type, season, avg(n) AS usual FROM w GROUP BY ALL)
    SELECT w.event_type, window_start::TIMESTAMP AS window_start, n, round(usual, 6) AS usual, round(abs(n - usual) / usual, 4) AS deviation FROM w JOIN b ON b.event_type = w.event_type AND b.season = w.season
    WHERE abs(n - usual) / usual > 0.5"""


def _alerts(found):
    return found.withColumn("window_start", F.col("window_start").cast("timestamp_ntz")).withColumn("usual", F.round("usual", 6))


@R.add("seasonal_volume_alerts", _VOLUMES)
def seasonal_volume_alerts(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return _alerts(monitor.volume_alerts(events, monitor.seasonal_baseline(events, "event_type"), "event_type", threshold=0.5))


@R.add(
    "stream_volume_alerts",
    _VOLUMES + " AND epoch_us(window_start) + 3600000000 <= (SELECT max(epoch_us(ts)) FROM events) - 7200000000",
)
def stream_volume_alerts(spark, sf_dir):
    """The alerts of a stream, for the windows that the watermark has passed."""
    baseline = monitor.seasonal_baseline(table(spark, sf_dir, "events"), "event_type")
    return _alerts(_replayed(spark, sf_dir, lambda events: monitor.volume_alerts(events, baseline, "event_type", threshold=0.5), "volume-alerts"))


_CHANGE = """CASE WHEN o_orderkey % 11 = 0 THEN o_orderdate + INTERVAL 400 DAY ELSE o_orderdate END"""


@R.add(
    "incremental_load",
    f"""SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'moved' WHEN o_orderkey % 7 = 0 THEN 'late' ELSE o_orderstatus END AS o_orderstatus, o_totalprice,
    CAST(year({_CHANGE}) AS INTEGER) AS year FROM orders""",
)
def incremental_load(spark, sf_dir):
    """Three loads of orders: the first, one of rows that move to another year, one of late and out-of-date changes."""
    path = shared_dir(spark, "incremental")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    day = lambda text: F.lit(text).cast("timestamp_ntz")
    moved, late = F.col("o_orderkey") % 11 == 0, (F.col("o_orderkey") % 7 == 0) & (F.col("o_orderkey") % 11 != 0)
    year = lambda date: F.year(date).cast("int").alias("year")
    columns = ["o_orderkey", "o_totalprice"]
    batches = [
        orders.select(*columns, "o_orderstatus", day("2026-01-01").alias("changed_at"), year(F.col("o_orderdate"))),
        orders.where(moved).select(*columns, F.lit("moved").alias("o_orderstatus"), day("2026-01-03").alias("changed_at"), year(F.col("o_orderdate") + F.expr("INTERVAL 400 DAY"))),
        orders.where(late).select(*columns, F.lit("late").alias("o_orderstatus"), day("2026-01-02 12:00:00").alias("changed_at"), year(F.col("o_orderdate"))).union(
            orders.where(moved).select(*columns, F.lit("old").alias("o_orderstatus"), day("2026-01-02 18:00:00").alias("changed_at"), year(F.col("o_orderdate")))
        ),
    ]
    for batch in batches:
        load(batch, path, "o_orderkey", "changed_at", "year")
    return spark.read.parquet(f"{path}/data").select(*columns, "o_orderstatus", F.col("year").cast("int").alias("year"))


_FIRST = """SELECT o_custkey, o_orderstatus, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS nth FROM orders"""


def _flat(spark, sf_dir):
    """A flat extract: customers with their first three orders side by side."""
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    first = table(spark, sf_dir, "orders").withColumn("nth", nth).where("nth <= 3")
    cells = [F.max(F.when(F.col("nth") == i, F.col(f"o_{c}"))).alias(f"order{i}_{c}") for i in (1, 2, 3) for c in ("orderstatus", "totalprice")]
    wide = first.groupBy("o_custkey").agg(*cells)
    return table(spark, sf_dir, "customer").join(wide, F.col("c_custkey") == F.col("o_custkey"), "left").drop("o_custkey")


@R.add("repeated_groups", f"SELECT c_custkey, CAST(nth AS VARCHAR) AS kind, o_orderstatus AS orderstatus, o_totalprice AS totalprice FROM customer JOIN ({_FIRST}) ON o_custkey = c_custkey WHERE nth <= 3")
def repeated_groups(spark, sf_dir):
    """The rows of the one repeated group that a flat extract has."""
    flat = _flat(spark, sf_dir)
    ((_, slots),) = repeated.by_number(flat.columns).items()
    return repeated.as_rows(flat, "c_custkey", slots)


@R.add(
    "lookup_columns",
    " UNION ALL ".join(
        f"""SELECT '{t}' AS "table", '{c}' AS column_name FROM {t} HAVING count(DISTINCT {c}) BETWEEN 3 AND 15 AND count(DISTINCT {c}) < 0.5 * count(*)"""
        for t, columns in {
            "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
            "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
            "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
            "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"],
        }.items()
        for c in columns
    ),
)
def lookup_columns(spark, sf_dir):
    found = [(t, c) for t in ("customer", "orders", "part", "lineitem") for c in repeated.lookup_columns(table(spark, sf_dir, t))]
    return spark.createDataFrame(found, "table string, column_name string")
