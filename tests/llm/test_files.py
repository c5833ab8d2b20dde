"""WARC archives and sharding."""

from __future__ import annotations

import gzip
import hashlib
import zlib

import pytest

from pyspark.sql import functions as F

from migcheck.llm import queries, sharding, warc
from migcheck.llm.shared import materialise, shared_dir


def expected_records(rows):
    first, count = {}, {}
    for r in rows:
        p = (r.html or "").encode()
        if len(p) >= 100:
            count[p] = count.get(p, 0) + 1
            if r.page_id is not None:
                first[p] = min(first.get(p, r.page_id), r.page_id)
    out = []
    for r in rows:
        p = (r.html or "").encode()
        original = first.get(p) if count.get(p, 0) > 1 else None
        again = original is not None and r.page_id != original
        out.append((r.page_id, len(p), hashlib.sha256(p).hexdigest(), "revisit" if again else "response", original if again else None))
    return sorted(out, key=str)


def round_trip(spark, pages, most_rows=500_000, **options):
    path = shared_dir(spark, "t-warc")
    warc.write(warc.resolve(pages, most_rows=most_rows), path, **options)
    return warc.read(spark, path)


def test_warc_members_end_with_zero():
    for parts in ((b"",), (b"a" * 99, b"b"), (bytes(range(256)) * (80 << 10),)):  # the last one over 16 MB
        data = warc.member(*parts)
        assert data[-1] == 0 and b"".join(warc.members(memoryview(data + data))) == b"".join(parts) * 2
        assert gzip.decompress(data) == b"".join(parts)


@pytest.mark.parametrize("most_rows", [500_000, 0])
def test_warc_odd_pages(spark, most_rows):
    long = "<p>äöü 👍 WARC/1.1\r\n\r\n</p>" * 12
    rows = [
        (4, "http://a/ x", long, "c", "h"), (2, None, long, "c", "h"), (9, "http://b\r\n", long + "x", "c", "h"),
        (None, "u", long, "c", "h"), (7, "u", None, None, "h"), (8, "u", "", "c", "h"), (1, "u", "short", "c", "h"), (3, "u", "short", "c", "h"),
        (2, "u", long, "c", "h"), (11, "u", "a\x00b\r\n" * 40, "c", "h"), (12, "u", "y" * 300_000, "c", "h"), (13, "u", "y" * 300_000, "c", "h"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, record_type string, block string")
    got = round_trip(spark, pages, most_rows, records_per_file=3)
    out = got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, out), key=str) == expected_records(pages.collect())
    kept = {r.page_id: bytes(r.payload) for r in got.where("record_type = 'response'").collect()}
    assert kept[2].decode() == long and kept[11] == b"a\x00b\r\n" * 40


def test_warc_no_pages(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    path = shared_dir(spark, "t-warc")
    warc.write(warc.resolve(pages), path)
    assert warc.read(spark, path).count() == 0


def test_warc_files_are_plain_archives(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h/{i % 2}", "<p>same page</p>" * 10) for i in range(5)], "page_id long, url string, html string")
    warc.write(warc.resolve(pages), str(tmp_path / "w"))
    whole = b"".join(gzip.decompress(f.read_bytes()) for f in (tmp_path / "w").glob("part-*"))
    assert whole.count(b"WARC/1.1\r\n") == 5 and whole.count(b"WARC-Refers-To-Target-URI: http://h/0\r\n") == 4
    assert whole.endswith(b"\r\n\r\n")


def test_warc_query(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = queries.op6_warc(spark, sf_dir).collect()
    assert sorted(map(tuple, got), key=str) == expected_records(pages.collect())


def check_shards(rows, shards):
    for s in {r.shard for r in rows}:
        own = sorted(r.slot for r in rows if r.shard == s)
        assert own == list(range(len(own)))
    loads = [sum(r.size for r in rows if r.shard == s) for s in range(shards)]
    return max(loads) / (sum(loads) / shards)


def test_sharding_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    rows = queries.op7_sharding(spark, sf_dir).collect()
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in rows) == sorted(
        (d.doc_id, len((d.text or "").encode()) + 1, zlib.crc32((d.text or "").encode())) for d in docs
    )
    assert check_shards(rows, 16) < 1.5
    assert {r.law for r in rows} == {"bytes"} and all(r.grown_shard is None for r in rows)


def test_sharding_odd_rows_and_frequent_id(spark):
    rows = [(None, None, "s"), (1, "", "s")] + [(7, f"text {i}", "s") for i in range(3000)] + [(7, "same", "s")] * 500
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    placed = sharding.records(docs)
    cells = materialise(sharding.cells_of(placed), "t-cells")
    first = sharding.first_map(sharding.slot_sizes(cells), 4)
    out = sharding.assign(placed, cells, first).withColumnRenamed("position", "slot").collect()
    assert len(out) == len(rows)
    assert check_shards(out, 4) < 1.1


def test_sharding_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    placed = sharding.records(docs)
    cells = sharding.cells_of(placed)
    first = sharding.first_map(sharding.slot_sizes(cells), 16)
    assert first.count() == sharding.SLOTS
    assert sharding.assign(placed, cells, first).count() == 0


def test_added_shard_takes_slots_only_into_itself(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = docs.crossJoin(spark.range(20)).selectExpr("doc_id * 20 + id AS doc_id", "concat(text, cast(id as string)) AS text")
    cells = sharding.cells_of(sharding.records(docs))
    path = shared_dir(spark, "t-map")
    sharding.save_map(sharding.first_map(sharding.slot_sizes(cells), 16), path)
    sharding.save_map(sharding.add_shard(sharding.load_map(spark, path), 16), path)
    old = {r.virtual_slot: r for r in sharding.load_map(spark, path, 1).collect()}
    new = {r.virtual_slot: r for r in sharding.load_map(spark, path).collect()}
    assert len(new) == sharding.SLOTS
    assert all(new[k].shard in (old[k].shard, 16) for k in new)
    loads = [sum(r.slot_bytes for r in new.values() if r.shard == s) for s in range(17)]
    assert max(loads) < 1.1 * sum(loads) / 17 and min(loads) > 0.85 * sum(loads) / 17


def test_rebalancing_moves_slots_from_overfull_shards_only(spark):
    sizes = spark.range(sharding.SLOTS).selectExpr("CAST(id AS int) AS virtual_slot", "1000 + id % 7 AS slot_bytes")
    path = shared_dir(spark, "t-map")
    sharding.save_map(sharding.first_map(sizes, 8), path)
    old = {r.virtual_slot: r.shard for r in sharding.load_map(spark, path).collect()}
    heavy = [s for s, owner in old.items() if owner in (2, 5)]
    grown = sizes.withColumn("slot_bytes", F.col("slot_bytes") * F.when(F.col("virtual_slot").isin(heavy), 3).otherwise(1)).cache()
    sharding.save_map(sharding.rebalance(sharding.load_map(spark, path), grown, 8), path)
    rows = sharding.load_map(spark, path).collect()
    assert len(rows) == sharding.SLOTS and {r.version for r in rows} == {2}
    moved = [r for r in rows if r.shard != old[r.virtual_slot]]
    assert moved and all(old[r.virtual_slot] in (2, 5) and r.shard not in (2, 5) for r in moved)
    loads = [sum(r.slot_bytes for r in rows if r.shard == s) for s in range(8)]
    assert max(loads) < 1.03 * sum(loads) / 8 and min(loads) > 0.97 * sum(loads) / 8
    with pytest.raises(Exception, match="(?i)exist"):
        sharding.save_map(sharding.load_map(spark, path, 2), path)
