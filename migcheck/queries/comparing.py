"""Legacy against modern: counts, keys, checksums, samples, aggregates, schemas."""

from __future__ import annotations

from pyspark.sql import functions as F

from migcheck.functions import compare
from migcheck.operators import checksum, comparing, governance, keys, reshape, schema
from migcheck.plans import loading
from migcheck.queries.common import MODERN, Registry, ctes, literal, modern_customer, modern_orders, table

R = Registry()


@R.add(
    "row_count",
    f"""WITH {MODERN}, c AS (SELECT (SELECT count(*) FROM orders) AS a, (SELECT count(*) FROM m_orders) AS b)
    SELECT a AS legacy_rows, b AS modern_rows, abs(a - b) AS difference, round(least(abs(a - b) * 100.0 / a, 30.0)::DOUBLE, 4) AS penalty,
        CASE WHEN a = b THEN 'PASS' ELSE 'FAIL' END AS status FROM c""",
)
def row_count(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return comparing.row_count(orders, modern_orders(orders))


@R.add(
    "orphans_same_source",
    f"""WITH {MODERN}, o AS (SELECT * FROM m_orders m WHERE NOT EXISTS (SELECT 1 FROM m_customer c WHERE c.customer_id = m.customer_id))
    SELECT count(*) AS n_orphans, count(*) FILTER (customer_id IS NULL) AS n_null_keys, least(count(*), 100)::BIGINT AS n_reported FROM o""",
)
def orphans_same_source(spark, sf_dir):
    child, parent = modern_orders(table(spark, sf_dir, "orders")), modern_customer(table(spark, sf_dir, "customer"))
    return keys.orphan_count(child, "customer_id", parent, "customer_id")


@R.add("orphans_cross_source", f"WITH {MODERN} SELECT customer_id AS key FROM m_orders WHERE customer_id IS NOT NULL EXCEPT SELECT customer_id FROM m_customer")
def orphans_cross_source(spark, sf_dir):
    child, parent = modern_orders(table(spark, sf_dir, "orders")), modern_customer(table(spark, sf_dir, "customer"))
    return keys.orphan_keys(child, "customer_id", parent, "customer_id")


def _checksum_sql(rows: str, column: str) -> str:
    return (
        f"SELECT '{column}' AS column_name, count({column}) AS n, "
        f"coalesce(sum(('0x' || substr(md5(CAST({column} AS VARCHAR)), 1, 15))::BIGINT::HUGEINT), 0)::VARCHAR AS checksum FROM {rows}"
    )


@R.add(
    "column_checksum",
    f"""WITH {MODERN}, l AS ({_checksum_sql("orders", "o_orderkey")} UNION ALL {_checksum_sql("orders", "o_orderstatus")}),
    m AS ({_checksum_sql("m_orders", "order_id")} UNION ALL {_checksum_sql("m_orders", "order_status")}),
    p AS (SELECT * FROM (VALUES ('o_orderkey', 'order_id'), ('o_orderstatus', 'order_status')) AS v(source, target))
    SELECT source, target, l.n AS legacy_n, m.n AS modern_n, l.checksum AS legacy_checksum, m.checksum AS modern_checksum,
        l.checksum = m.checksum AS matches FROM p JOIN l ON l.column_name = source JOIN m ON m.column_name = target""",
)
def column_checksum(spark, sf_dir):
    return _compare_checksums(spark, sf_dir, [("o_orderkey", "order_id"), ("o_orderstatus", "order_status")])


def _compare_checksums(spark, sf_dir, mapped):
    orders = table(spark, sf_dir, "orders")
    pairs = spark.createDataFrame(mapped, "source string, target string")
    old = checksum.column_checksums(orders, [a for a, _ in mapped]).toDF("source", "legacy_n", "legacy_checksum")
    new = checksum.column_checksums(modern_orders(orders), [b for _, b in mapped]).toDF("target", "modern_n", "modern_checksum")
    return pairs.join(old, "source").join(new, "target").withColumn("matches", F.col("legacy_checksum") == F.col("modern_checksum"))


_MAPPED = [
    ("o_orderkey", "order_id"), ("o_custkey", "customer_id"), ("o_orderstatus", "order_status"), ("o_totalprice", "total_price"), ("o_orderdate", "ordered_at"),
]


@R.add(
    "column_checksum_all",
    f"""WITH {MODERN}, l AS ({" UNION ALL ".join(_checksum_sql("orders", a) for a, _ in _MAPPED)}),
    m AS ({" UNION ALL ".join(_checksum_sql("m_orders", b) for _, b in _MAPPED)}),
    p AS (SELECT * FROM (VALUES {", ".join(map(str, _MAPPED))}) AS v(source, target))
    SELECT source, target, l.n AS legacy_n, m.n AS modern_n, l.checksum AS legacy_checksum, m.checksum AS modern_checksum,
        l.checksum = m.checksum AS matches FROM p JOIN l ON l.column_name = source JOIN m ON m.column_name = target""",
)
def column_checksum_all(spark, sf_dir):
    return _compare_checksums(spark, sf_dir, _MAPPED)


@R.add("column_checksum_md5", "SELECT md5(string_agg(CAST(c_custkey AS VARCHAR), '' ORDER BY c_custkey)) AS checksum FROM customer")
def column_checksum_md5(spark, sf_dir):
    return checksum.streamed_md5(table(spark, sf_dir, "customer"), "c_custkey")


_ORDERS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
_WRITTEN = ", ".join(f"coalesce(replace(replace(CAST({c} AS VARCHAR), '\\', '\\\\'), '|', '\\|'), '\\N')" for c in _ORDERS)


@R.add("row_checksum", f"SELECT count(*) AS n, sum(('0x' || substr(md5(concat_ws('|', {_WRITTEN})), 1, 15))::BIGINT::HUGEINT)::VARCHAR AS checksum FROM orders")
def row_checksum(spark, sf_dir):
    return checksum.row_checksum(table(spark, sf_dir, "orders"), _ORDERS)


_GROUPS = f"""WITH {MODERN}, l AS (SELECT upper(o_orderstatus) AS status, count(*) AS n, sum(o_totalprice::DECIMAL(18,2)) AS total FROM orders GROUP BY 1),
    m AS (SELECT upper(order_status) AS status, count(*) AS n, sum(total_price::DECIMAL(18,2)) AS total FROM m_orders GROUP BY 1)"""


def _groups(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")

    def grouped(df, status, price):
        total = F.sum(F.col(price).cast("decimal(18,2)"))
        return df.groupBy(F.upper(status).alias("status")).agg(F.count("*").alias("n"), total.alias("total"))

    return grouped(orders, "o_orderstatus", "o_totalprice"), grouped(modern_orders(orders), "order_status", "total_price")


@R.add(
    "agg_status_counts",
    _GROUPS + """ SELECT coalesce(l.status, m.status) AS status, l.n AS legacy_n, m.n AS modern_n,
        coalesce(l.n, 0) = coalesce(m.n, 0) AS agrees FROM l FULL JOIN m ON l.status = m.status""",
)
def agg_status_counts(spark, sf_dir):
    old, new = _groups(spark, sf_dir)
    return comparing.compare_groups(old, new, ["status"], ["n"])


@R.add(
    "agg_sum_tolerance",
    _GROUPS + """ SELECT coalesce(l.status, m.status) AS status, l.total::DOUBLE AS legacy_total, m.total::DOUBLE AS modern_total,
        abs(coalesce(l.total, 0) - coalesce(m.total, 0)) <= 1000 AS agrees FROM l FULL JOIN m ON l.status = m.status""",
)
def agg_sum_tolerance(spark, sf_dir):
    old, new = _groups(spark, sf_dir)
    found = comparing.compare_groups(old, new, ["status"], ["total"], tolerance=1000)
    return found.withColumns({c: F.col(c).cast("double") for c in ("legacy_total", "modern_total")})


_SAMPLE = "SELECT o_orderkey FROM orders WHERE o_orderkey IS NOT NULL ORDER BY md5(CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT 100"


@R.add("sample_rows", f"SELECT o.* FROM orders o JOIN ({_SAMPLE}) USING (o_orderkey)")
def sample_rows(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return orders.join(F.broadcast(comparing.sample_keys(orders, "o_orderkey", 100)), "o_orderkey", "left_semi")


@R.add("sample_keys", f"WITH {MODERN} SELECT m.order_id, m.customer_id FROM m_orders m JOIN ({_SAMPLE}) s ON m.order_id = s.o_orderkey")
def sample_keys(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    found = F.broadcast(comparing.sample_keys(orders, "o_orderkey", 100).withColumnRenamed("o_orderkey", "order_id"))
    return modern_orders(orders).join(found, "order_id", "left_semi").select("order_id", "customer_id")


_PAIRS = [("o_custkey", "customer_id"), ("o_orderstatus", "order_status"), ("o_totalprice", "total_price"), ("o_orderdate", "ordered_at")]
_EQUAL = """o_custkey = customer_id AND lower(trim(o_orderstatus)) = lower(trim(order_status)) AND abs(o_totalprice - total_price) < 0.001
    AND CAST(o_orderdate AS DATE) = CAST(ordered_at AS DATE)"""


@R.add(
    "sample_compare",
    f"""WITH {MODERN}, s AS ({_SAMPLE}), j AS (SELECT {_EQUAL} AS equal FROM s JOIN orders o USING (o_orderkey) JOIN m_orders ON order_id = o.o_orderkey),
    t AS (SELECT count(*) AS k, count(*) FILTER (equal) AS e FROM j), r AS (SELECT *, e * 100.0::DOUBLE / k AS rate, (SELECT count(*) FROM s) AS n FROM t)
    SELECT n AS sampled, k AS matched_keys, n - k AS missing_keys, e AS equal_rows, round(rate, 4) AS match_rate, round((100 - rate) * 0.3::DOUBLE, 4) AS penalty,
        CASE WHEN rate = 100 THEN 'PASS' WHEN rate >= 90 THEN 'WARN' ELSE 'FAIL' END AS status FROM r""",
)
def sample_compare(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return comparing.sample_compare(orders, modern_orders(orders), ("o_orderkey", "order_id"), _PAIRS)


@R.add("keyed_compare", f"WITH {MODERN} SELECT count(*) AS matched_keys, count(*) FILTER ({_EQUAL}) AS equal_rows FROM orders JOIN m_orders ON order_id = o_orderkey")
def keyed_compare(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    found = comparing.matched(orders, modern_orders(orders), ("o_orderkey", "order_id"), _PAIRS)
    return found.agg(F.count("*").alias("matched_keys"), F.count_if("equal").alias("equal_rows"))


def _schemas(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return schema.schema_of(spark, orders), schema.schema_of(spark, modern_orders(orders))


_OLD = """old AS (SELECT * FROM (VALUES ('o_orderkey', 'bigint'), ('o_custkey', 'bigint'), ('o_orderstatus', 'varchar'), ('o_totalprice', 'double'),
    ('o_orderdate', 'timestamp'), ('o_orderpriority', 'varchar')) AS v(column_name, data_type))"""
_NEW = """new AS (SELECT * FROM (VALUES ('order_id', 'bigint'), ('customer_id', 'bigint'), ('order_status', 'varchar'), ('total_price', 'double'),
    ('ordered_at', 'timestamp')) AS v(column_name, data_type))"""
_MAPS = ctes("mappings")


@R.add(
    "schema_diff",
    f"""WITH {_OLD}, {_NEW}, both_sides AS (SELECT coalesce(o.column_name, n.column_name) AS column_name, o.data_type AS legacy_type, n.data_type AS modern_type
        FROM old o FULL JOIN new n ON o.column_name = n.column_name)
    SELECT *, CASE WHEN modern_type IS NULL THEN 'missing_in_modern' WHEN legacy_type IS NULL THEN 'missing_in_legacy'
        WHEN legacy_type <> modern_type THEN 'type_mismatch' ELSE 'same' END AS change FROM both_sides""",
)
def schema_diff(spark, sf_dir):
    return schema.schema_diff(*_schemas(spark, sf_dir))


@R.add(
    "schema_penalty",
    f"""WITH {_OLD}, {_NEW}, {_MAPS}, lost AS (SELECT column_name FROM old WHERE column_name NOT IN (SELECT column_name FROM new)),
    p AS (SELECT coalesce(sum(CASE WHEN type IN ('rename', 'transform') THEN 0 WHEN type = 'archived' THEN 1 ELSE 4 END), 0)::BIGINT AS penalty
        FROM lost LEFT JOIN mappings ON source = column_name)
    SELECT penalty, CASE WHEN penalty = 0 THEN 'PASS' WHEN penalty < 20 THEN 'WARN' ELSE 'FAIL' END AS status FROM p""",
)
def schema_penalty(spark, sf_dir):
    return schema.schema_penalty(schema.schema_diff(*_schemas(spark, sf_dir)), literal(spark, "mappings"))


_STORED = [("c_custkey", "bigint"), ("c_name", "varchar"), ("c_nationkey", "bigint"), ("c_acctbal", "double"), ("c_region", "varchar")]


@R.add(
    "schema_drift",
    f"""WITH stored AS (SELECT * FROM (VALUES {", ".join(map(str, _STORED))}) AS v(column_name, data_type)), now AS (SELECT column_name, lower(column_type) AS data_type FROM (DESCRIBE customer))
    SELECT coalesce(s.column_name, n.column_name) AS column_name, s.data_type AS baseline_type, n.data_type AS current_type,
        CASE WHEN s.data_type IS NULL THEN 'added' WHEN n.data_type IS NULL THEN 'dropped' ELSE 'type_changed' END AS change
    FROM stored s FULL JOIN now n ON s.column_name = n.column_name WHERE s.data_type IS DISTINCT FROM n.data_type""",
)
def schema_drift(spark, sf_dir):
    return schema.schema_drift(spark.createDataFrame(_STORED, "column_name string, data_type string"), schema.schema_of(spark, table(spark, sf_dir, "customer")))


@R.add("unmapped_columns", f"WITH {_NEW}, {_MAPS} SELECT column_name FROM new WHERE column_name NOT IN (SELECT target FROM mappings WHERE target IS NOT NULL AND target <> 'total_price')")
def unmapped_columns(spark, sf_dir):
    return schema.unmapped_columns(_schemas(spark, sf_dir)[1], literal(spark, "mappings").where("target IS NULL OR target <> 'total_price'"))


@R.add(
    "archived_leakage",
    f"""WITH {_MAPS}, now AS (SELECT column_name FROM (DESCRIBE WITH {MODERN} SELECT * FROM m_customer)), gone AS (SELECT unnest([source, target]) AS column_name FROM mappings WHERE type = 'archived')
    SELECT column_name FROM now WHERE column_name IN (SELECT column_name FROM gone WHERE column_name IS NOT NULL)""",
)
def archived_leakage(spark, sf_dir):
    return schema.archived_leakage(schema.schema_of(spark, modern_customer(table(spark, sf_dir, "customer"))), literal(spark, "mappings"))


@R.add(
    "column_pairs",
    f"""WITH {_OLD}, {_NEW}, {_MAPS} SELECT source, target FROM mappings WHERE type NOT IN ('removed', 'transform', 'archived')
        AND source IN (SELECT column_name FROM old) AND target IN (SELECT column_name FROM new)
    UNION ALL SELECT o.column_name, n.column_name FROM old o JOIN new n USING (column_name) WHERE o.column_name NOT IN (SELECT source FROM mappings)""",
)
def column_pairs(spark, sf_dir):
    return schema.column_pairs(*_schemas(spark, sf_dir), literal(spark, "mappings"))


@R.add(
    "apply_mapping",
    f"""WITH {_MAPS}, plan AS (SELECT * FROM (VALUES ('orders', 'o_orderkey'), ('customer', 'c_nationkey'), ('supplier', 's_name')) AS v("table", "column"))
    SELECT p."table", p."column", coalesce(e.target, g.target, p."column") AS modern FROM plan p LEFT JOIN mappings e ON e."table" = p."table" AND e.source = p."column"
        LEFT JOIN mappings g ON g."table" IS NULL AND g.source = p."column" """,
)
def apply_mapping(spark, sf_dir):
    plan = spark.createDataFrame([("orders", "o_orderkey"), ("customer", "c_nationkey"), ("supplier", "s_name")], "table string, column string")
    return schema.apply_mapping(plan, literal(spark, "mappings"))


@R.add(
    "reconstruct_flat",
    """SELECT c_custkey, c_name, c_acctbal, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""",
)
def reconstruct_flat(spark, sf_dir):
    children = [(table(spark, sf_dir, "nation"), "c_nationkey", "n_nationkey"), (table(spark, sf_dir, "region"), "n_regionkey", "r_regionkey")]
    return reshape.reconstruct_flat(table(spark, sf_dir, "customer"), children).select("c_custkey", "c_name", "c_acctbal", "n_name", "r_name")


@R.add(
    "normalization_integrity",
    f"""WITH {MODERN}, x AS (SELECT (SELECT count(*) FROM orders) AS n_flat, (SELECT count(*) FROM m_orders) AS n_primary, 0::BIGINT AS n_empty_children,
        (SELECT count(*) FROM lineitem WHERE l_orderkey IS NULL OR l_orderkey NOT IN (SELECT order_id FROM m_orders)) AS n_orphans),
    y AS (SELECT *, least(30, 5 * (CASE WHEN n_flat <> n_primary THEN 1 ELSE 0 END + CASE WHEN n_orphans > 0 THEN 1 ELSE 0 END) + 2 * n_empty_children)::BIGINT AS penalty FROM x)
    SELECT *, CASE WHEN penalty = 0 THEN 'PASS' WHEN penalty >= 10 THEN 'FAIL' ELSE 'WARN' END AS status FROM y""",
)
def normalization_integrity(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return loading.normalization_integrity(orders, modern_orders(orders), [(table(spark, sf_dir, "lineitem"), "l_orderkey", "order_id")])


@R.add(
    "transform_select",
    """SELECT c_custkey AS customer_id, sha256(c_name) AS name_hash, c_mktsegment IN ('1', 'T', 'Y') OR c_mktsegment = 'TRUE' AS is_active,
        CAST(c_acctbal AS DECIMAL(12,2))::DOUBLE AS balance FROM customer""",
)
def transform_select(spark, sf_dir):
    columns = {
        "customer_id": F.col("c_custkey"),
        "name_hash": reshape.hashed(F.col("c_name")),
        "is_active": reshape.yes(F.col("c_mktsegment")),
        "balance": F.col("c_acctbal").cast("decimal(12,2)").cast("double"),
    }
    return reshape.transform_select(table(spark, sf_dir, "customer"), columns)


@R.add("archive_columns", "SELECT c_custkey, sha256(c_name) AS c_name, c_nationkey, c_mktsegment FROM customer")
def archive_columns(spark, sf_dir):
    return table(spark, sf_dir, "customer").drop("c_acctbal").withColumn("c_name", reshape.hashed(F.col("c_name")))


@R.add("full_load", "SELECT c_custkey AS customer_id, c_name AS customer_name FROM customer WHERE c_custkey % 31 <> 0")
def full_load(spark, sf_dir):
    from migcheck.sources.tables import full_load as load
    from migcheck.sources.shared import shared_dir

    path = shared_dir(spark, "full-load")
    load(modern_customer(table(spark, sf_dir, "customer")).select("customer_id", "customer_name"), path)
    return spark.read.parquet(path)


@R.add(
    "upsert",
    """SELECT c_custkey, c_name FROM customer WHERE c_custkey % 10 <> 0 UNION ALL SELECT c_custkey, upper(c_name) FROM customer WHERE c_custkey % 10 = 0""",
)
def upsert(spark, sf_dir):
    from migcheck.sources.tables import upsert as merge

    now = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return merge(now, now.where("c_custkey % 10 = 0").withColumn("c_name", F.upper("c_name")), "c_custkey")


@R.add(
    "unpivot_groups",
    """SELECT c_custkey, 'primary' AS kind, c_name AS value, c_mktsegment AS note FROM customer
    UNION ALL SELECT c_custkey, 'other', CASE WHEN c_custkey % 3 = 0 THEN 'p' || c_custkey END, NULL FROM customer WHERE c_custkey % 3 = 0""",
)
def unpivot_groups(spark, sf_dir):
    phone = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("p"), F.col("c_custkey").cast("string")))
    df = table(spark, sf_dir, "customer").withColumn("other", phone).withColumn("none", F.lit(None).cast("string"))
    return reshape.unpivot_groups(df, "c_custkey", {"primary": {"value": "c_name", "note": "c_mktsegment"}, "other": {"value": "other", "note": "none"}})


@R.add("shorten", "SELECT p_partkey, CASE WHEN length(p_name) > 12 THEN p_name[:12] || '...' ELSE p_name END AS name, CAST(p_partkey AS VARCHAR)[:2] AS head FROM part")
def shorten(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", compare.shortened(F.col("p_name"), 12, "...").alias("name"), compare.shortened(F.col("p_partkey"), 2).alias("head"))


@R.add("rownum", "SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_orderkey)::INTEGER AS row_number FROM orders ORDER BY o_orderkey LIMIT 100")
def rownum(spark, sf_dir):
    return reshape.numbered(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), ["o_orderkey"], 100)


_DAMAGED = """damaged AS (SELECT c_custkey, CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE c_custkey // 2 END AS key,
    CASE WHEN c_custkey % 17 = 0 THEN 'n/a' ELSE CAST(c_nationkey AS VARCHAR) END AS nation FROM customer)"""


@R.add(
    "frame_schema_check",
    f"""WITH {_DAMAGED} SELECT 'type' AS "check", 'nation' AS column_name, count(*) FILTER (nation IS NOT NULL AND try_cast(nation AS INTEGER) IS NULL) AS n FROM damaged
    UNION ALL SELECT 'not_null', 'key', count(*) FILTER (key IS NULL) FROM damaged
    UNION ALL SELECT 'unique', 'key', coalesce(sum(c), 0)::BIGINT FROM (SELECT count(*) AS c FROM damaged WHERE key IS NOT NULL GROUP BY key HAVING count(*) > 1)""",
)
def frame_schema_check(spark, sf_dir):
    key = F.col("c_custkey")
    df = table(spark, sf_dir, "customer").select(
        F.when(key % 13 != 0, F.floor(key / 2)).alias("key"), F.when(key % 17 == 0, "n/a").otherwise(F.col("c_nationkey").cast("string")).alias("nation")
    )
    return governance.schema_failures(df, {"nation": "int"}, ["key"], ["key"])
