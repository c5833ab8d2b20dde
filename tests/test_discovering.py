"""References, keys, near vectors, changed ranges and sketches, on small tables worked out by hand or by brute force."""

from __future__ import annotations

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from migcheck.operators import inclusion, merkle, sketches, uniqueness, vector, vector_index
from migcheck.queries import discovering


def test_inclusions(spark):
    parents = spark.createDataFrame([(1, "x", 1.0), (2, "y", -0.0), (3, None, 2.0)], "id int, name string, rate double")
    children = spark.createDataFrame([(1, "x", 0.0), (1, "z" * 200, None), (9, None, 2.0), (None, "x", 5.0)], "parent long, word string, share double")
    got = {(r.child_column, r.parent_column): (r.n_values, r.n_shared, r.parent_unique) for r in inclusion.inclusions({"p": parents, "c": children}).collect()}
    assert got == {
        ("parent", "id"): (2, 1, True), ("id", "parent"): (3, 1, False),
        ("word", "name"): (2, 1, True), ("name", "word"): (2, 1, False),
        ("share", "rate"): (3, 2, True), ("rate", "share"): (3, 2, True),
    }
    found = inclusion.references(inclusion.inclusions({"p": parents, "c": children}), least=0.6)
    assert {(r.child_column, r.n_orphans) for r in found.collect()} == {("share", 1), ("rate", 1)}


def test_inclusions_of_many_columns_and_empty_tables(spark):
    wide = spark.range(5).select(*(F.col("id").alias(f"c{i}") for i in range(130)))
    assert inclusion.inclusions({"w": wide}).count() == 130 * 129
    assert inclusion.inclusions({"w": wide, "e": wide.where("false").select("c0", F.array("c1").alias("list"))}).where("child_table = 'e' OR parent_table = 'e'").count() == 0


def brute_keys(rows, names, largest=3):
    from itertools import combinations

    names = [c for c in sorted(names) if all(r[c] is not None for r in rows)]
    found = []
    for size in range(1, largest + 1):
        for s in combinations(names, size):
            if rows and not any(set(k) <= set(s) for k in found) and len({tuple(r[c] for c in s) for r in rows}) == len(rows):
                found.append(s)
    return found


@pytest.mark.parametrize("seed", range(4))
def test_minimal_keys(spark, seed):
    rng = random.Random(seed)
    rows = [{"a": i // 10, "b": i % 10, "c": rng.randint(0, 30), "d": rng.choice([None, 1]) if i else None, "e": i % 7, "f": rng.randint(0, 5)} for i in range(100)]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "a int, b int, c int, d int, e int, f int")
    assert uniqueness.minimal_keys(df) == brute_keys(rows, "abcdef")
    assert uniqueness.minimal_keys(df.where("false")) == []


def test_dependencies(spark):
    rows = [(1, "x", 10, None, 0), (1, "x", 10, 5, 0), (2, "y", 10, 5, 0), (3, None, 30, 5, 0), (3, None, 30, 6, 0), (4, "y", 10, 6, 0)]
    df = spark.createDataFrame(rows, "a int, b string, c int, d int, constant int")
    got = {(r.determinant, r.dependent) for r in uniqueness.functional_dependencies(df).collect()}
    assert got == {("a", "b"), ("a", "c"), ("b", "c")}
    assert uniqueness.functional_dependencies(df.where("false")).count() == 0


def vectors_of(spark, n, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, 16))
    rows = [(i, (centres[i % 12] + 0.1 * rng.normal(size=16)).tolist()) for i in range(n)]
    rows += [(n + i, centres[0].tolist()) for i in range(n // 2)]  # a third of all rows is one vector
    return spark.createDataFrame([*rows, (None, [0.0] * 16), (-1, None)], "vec_id long, embedding array<double>")


@pytest.mark.parametrize("cosine", [False, True])
def test_exact_search_equals_all_pairs(spark, tmp_path, monkeypatch, cosine):
    monkeypatch.setattr(vector_index, "PART", 100)
    monkeypatch.setattr(vector_index, "BLOCK", 40)
    vectors = vectors_of(spark, 600)
    index = vector_index.build(vectors, f"file://{tmp_path}/index", cosine=cosine)
    assert index.blocks.agg(F.sum("size")).first()[0] == 900 and index.parts.agg(F.max("parts")).first()[0] > 1
    queries = vectors.where("vec_id % 50 = 0")
    length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x))
    scaled = vectors.withColumn("embedding", F.transform("embedding", lambda x: x / length)) if cosine else vectors
    expected = {tuple(r) for r in vector.top_similar(scaled, scaled.where("vec_id % 50 = 0"), 7).select("query_id", "vec_id", "score", "rank").collect()}
    found = vector_index.search(index, queries, 7, probes=2, exact=True)
    assert {tuple(r) for r in found.select("query_id", "vec_id", "score", "rank").collect()} == expected
    probes = vector_index.probes_for(index, vectors.where("vec_id % 50 <> 0"), 7)
    row = vector_index.recall(vector_index.search(index, queries, 7, probes=probes, exact=True)).first()
    assert row.recall >= 0.9 and row.n_rows == 7 * 18


def test_search_plan_has_no_cross_join(spark, tmp_path):
    index = vector_index.build(vectors_of(spark, 100), f"file://{tmp_path}/index")
    plan = vector_index.search(index, vectors_of(spark, 100).where("vec_id = 0"), 5)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_index_of_nothing(spark, tmp_path):
    index = vector_index.build(vectors_of(spark, 10).where("false"), f"file://{tmp_path}/index")
    assert vector_index.search(index, vectors_of(spark, 10), 5, exact=True).count() == 0


def trees(spark, tmp_path, *sides):
    out = []
    for i, df in enumerate(sides):
        merkle.tree(df, "k", ["k", "v"], width=10).write.partitionBy("level").parquet(f"file://{tmp_path}/{i}")
        out.append(spark.read.parquet(f"file://{tmp_path}/{i}"))
    return out


def test_merkle_names_differing_keys(spark, tmp_path):
    left = spark.createDataFrame([(i, f"v{i}") for i in range(-500, 5_000)] + [(7, "again"), (None, "a"), (None, None)], "k long, v string")
    right = left.where("k IS NULL OR k <> 1234").withColumn("v", F.when(F.col("k") == 77, F.lit(None)).when(F.col("k") == -33, "x|y").otherwise(F.col("v")))
    right = right.where("NOT (k = 7 AND v = 'again')").union(spark.createDataFrame([(900_000, "new"), (None, "b")], "k long, v string"))
    nodes = merkle.differing_nodes(*trees(spark, tmp_path, left, right))
    leaves = nodes.where("level = 0")
    assert {r.node for r in leaves.collect()} == {123, 7, -4, 0, 90_000, None}
    got = {(r.key, r.change) for r in merkle.differing_keys(left, right, "k", ["k", "v"], leaves, width=10).collect()}
    assert got == {(1234, "missing"), (77, "changed"), (-33, "changed"), (7, "changed"), (900_000, "added"), (None, "changed")}


def test_merkle_reads_only_differing_ranges(spark, tmp_path):
    path = f"file://{tmp_path}/rows"
    spark.range(10_000).select(F.col("id").alias("k"), F.col("id").cast("string").alias("v")).write.parquet(path)
    left = spark.read.parquet(path)
    right = left.withColumn("v", F.when(F.col("k").between(95, 104), "x").otherwise(F.col("v")))
    leaves = merkle.differing_nodes(*trees(spark, tmp_path / "t", left, right)).where("level = 0")
    assert "GreaterThanOrEqual(k,90), LessThan(k,110)" in merkle.in_leaves(left, "k", leaves, 10)._jdf.queryExecution().toString().replace("PushedFilters: [IsNotNull(k), ", "")
    many = spark.range(0, 2_000, 2).withColumnRenamed("id", "node")
    assert merkle.in_leaves(left, "k", many, 10).count() == 5_000
    equal = merkle.differing_nodes(*trees(spark, tmp_path / "e", left, left))
    assert equal.count() == 0


def test_sketches_of_parts_merge_to_the_whole(spark):
    df = spark.range(21_000).select((F.col("id") % 3_000).alias("a"), F.when(F.col("id") % 4 > 0, F.col("id").cast("string")).alias("b"), (F.col("id") % 5).alias("day"), F.array("id").alias("list"))
    whole = {r.column_name: r for r in sketches.estimates(sketches.merged(sketches.column_sketches(df.drop("day")), ["column_name"])).collect()}
    parts = {r.column_name: r for r in sketches.estimates(sketches.merged(sketches.column_sketches(df, by=["day"]), ["column_name"])).collect()}
    assert set(whole) == set(parts) == {"a", "b"}
    for name, exact in (("a", 3_000), ("b", 15_750)):
        assert abs(whole[name].distinct_estimate - exact) < 0.03 * exact and abs(parts[name].distinct_estimate - exact) < 0.03 * exact
        assert (whole[name].n, whole[name].n_null) == (parts[name].n, parts[name].n_null) == (21_000, 0 if name == "a" else 5_250)
    for q, got in zip((0.25, 0.5, 0.75), parts["a"].quantiles):
        assert abs(got - q * 3_000) < 60
    assert parts["b"].quantiles is None
    halves = df.withColumn("day", F.col("day") % 2)
    again = {r.column_name: r for r in sketches.estimates(sketches.merged(sketches.column_sketches(halves, by=["day"]), ["column_name"])).collect()}
    assert all(abs(again[c].distinct_estimate - parts[c].distinct_estimate) < 0.01 * parts[c].distinct_estimate for c in again)  # however the rows were parted


def test_sketch_overlap_and_drift(spark):
    before = spark.range(10_000).select(F.col("id").alias("key"), (F.col("id") % 100).alias("part"), F.lit(None).cast("int").alias("none"))
    now = spark.range(5_000, 15_000).select(F.col("id").alias("key"), (F.col("id") % 400).alias("part"), F.lit(None).cast("int").alias("none"))
    a, b = sketches.column_sketches(before), sketches.column_sketches(now)
    shared = {(r.left_column, r.right_column): r.coverage for r in sketches.overlap(a, b).collect()}
    assert abs(shared["key", "key"] - 0.5) < 0.04 and shared["part", "key"] == 0
    assert {(r.column_name, r.change) for r in sketches.drift(a, b).collect()} == {("part", "distinct"), ("part", "quantile"), ("key", "quantile")}
    assert sketches.drift(a, a).count() == 0
    empty = sketches.estimates(sketches.column_sketches(before.where("false")))
    assert {(r.column_name, r.n, r.distinct_estimate) for r in empty.collect()} == {(c, 0, 0) for c in ("key", "part", "none")}


def test_keys_are_looked_for_in_slices_and_by_whole_sets(spark, monkeypatch):
    monkeypatch.setattr(uniqueness, "LEAST", 10)
    monkeypatch.setattr(uniqueness, "TASK", 100)
    monkeypatch.setattr(uniqueness, "ALONE", 100)
    rows = [{"a": i % 40, "b": f"x{i // 40}", "c": float(i % 60), "d": i // 60, "e": "y" * 300 + str(i % 7)} for i in range(2_400)]
    rows += [{"a": 40, "b": "x70", "c": 0.0, "d": 99, "e": "z"}, {"a": 40, "b": "x71", "c": -0.0, "d": 99, "e": "z"}]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "a int, b string, c double, d int, e string")
    assert uniqueness.minimal_keys(df) == brute_keys(rows, "abcde")
    assert ("a", "b") in uniqueness.minimal_keys(df) and ("c", "d") not in uniqueness.minimal_keys(df)
    names = ["a", "b", "c", "d", "e"]
    assert uniqueness.repeated(df, [("a", "b"), ("c", "d")], 2_402, names) == {("c", "d")}


def test_each_row_is_dealt_out_once_for_sets_that_share_a_column(spark):
    assert uniqueness.dealt([("a", "b"), ("a", "c"), ("d",)], set()) == {("a",): [("a", "b"), ("a", "c")], ("d",): [("d",)]}
    assert uniqueness.dealt([("a", "b"), ("a", "c")], {"a", "b"}) == {("a", "b"): [("a", "b")], ("c",): [("a", "c")]}


def test_inclusions_meet_negative_zero_as_their_sql_does(spark, sf_dir, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    for name in discovering.COLUMNS:
        df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        if name == "customer":
            df = df.withColumn("c_acctbal", F.when(F.col("c_custkey") % 2 == 0, F.lit(-0.0)).otherwise(F.col("c_acctbal")))
        df.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    for query in ("inclusion_dependencies", "derived_references"):
        expected = set(db.execute(discovering.R.oracles[query]).fetchall())
        assert {tuple(r) for r in discovering.R.queries[query](spark, str(tmp_path)).collect()} == expected


def test_cells_of_queries_are_given_in_bounded_steps(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vector_index, "STEP", 20_000)
    index = vector_index.build(vectors_of(spark, 600), f"file://{tmp_path}/index", cells=40)
    batch = pa.RecordBatch.from_pydict({"vec_id": list(range(100)), "embedding": [[float(i)] * 16 for i in range(100)]})
    cut = list(vector_index.steps(iter([batch, batch.slice(0, 0)]), 40))
    assert sum(b.num_rows for b in cut) == 100 and max(b.num_rows for b in cut) * 40 * 16 * 8 <= 20_000
    assert [x for b in cut for x in b["vec_id"].to_pylist()] == list(range(100))
    values, centroids = np.random.default_rng(0).normal(size=(500, 16)), np.random.default_rng(1).normal(size=(40, 16))
    cell, far = vector_index.nearest(values, centroids)
    distances = np.linalg.norm(values[:, None] - centroids, axis=2)
    assert (cell == distances.argmin(1)).all() and np.allclose(far, distances.min(1))
    found = vector_index.search(index, vectors_of(spark, 600).where("vec_id % 50 = 0"), 7, probes=2, exact=True)
    expected = vector.top_similar(vectors_of(spark, 600), vectors_of(spark, 600).where("vec_id % 50 = 0"), 7)
    assert {tuple(r) for r in found.select("query_id", "vec_id", "score", "rank").collect()} == {tuple(r) for r in expected.collect()}


def test_products_of_blocks_take_bounded_memory():
    rng = np.random.default_rng(0)
    questions, values, ids = rng.normal(size=(1_000, 16)), rng.normal(size=(1_000, 16)), rng.permutation(1_000)
    tracemalloc.start()
    others, score = vector.closest(questions, values, ids, 5)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 8_000_000  # less than all products
    exact = np.round(questions @ values.T, 4)
    for row in range(0, 1_000, 100):
        want = np.lexsort((ids, -exact[row]))[:5]
        assert others[row].tolist() == ids[want].tolist() and np.allclose(score[row], exact[row][want])
