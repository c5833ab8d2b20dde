"""Normalisation, types, observation and review notes over the driver tables and literal metadata."""

from __future__ import annotations

from pyspark.sql import functions as F

from migcheck.functions import names
from migcheck.operators import comparing, inference, legacy_code, normalize, profile, transforms, vector
from migcheck.plans import observer
from migcheck.queries.common import MODERN, Registry, ctes, literal, modern_orders, table

R = Registry()

_NAMES = ctes("names")
_GROUPS = f"""WITH {_NAMES}, n AS (SELECT 'flat' AS "table", source AS column_name, lower(regexp_extract(source, '^([A-Za-z]{{2,4}})_', 1)) AS own FROM names),
    s AS (SELECT own, count(*) AS size FROM n WHERE own <> '' GROUP BY 1 HAVING count(*) >= 3),
    m AS (SELECT count(*) AS k, (SELECT own FROM s ORDER BY size DESC, own LIMIT 1) AS largest FROM s),
    g AS (SELECT "table", column_name, CASE WHEN s.own IS NOT NULL THEN n.own ELSE coalesce(largest, '') END AS prefix,
        CASE k WHEN 0 THEN 0.8::DOUBLE WHEN 1 THEN 0.9::DOUBLE ELSE 0.7::DOUBLE END AS confidence FROM n LEFT JOIN s ON s.own = n.own, m)"""


def _flat(spark):
    return literal(spark, "names").select(F.lit("flat").alias("table"), F.col("source").alias("column_name"))


@R.add("column_groups", _GROUPS + " SELECT * FROM g")
def column_groups(spark, sf_dir):
    return normalize.column_groups(_flat(spark))


def _any_part(parts):
    return "(" + " OR ".join(f"contains(bare, '{p}')" for p in parts) + ")"


_PARTS = _GROUPS + f""", b AS (SELECT *, regexp_replace(lower(column_name), '^[a-z]{{2,4}}_', '') AS bare FROM g),
    k AS (SELECT "table", column_name, prefix, confidence, CASE WHEN {_any_part(normalize.ADDRESS)} THEN 'addresses' WHEN {_any_part(normalize.CONTACT)} THEN 'contacts' ELSE 'main' END AS kind FROM b),
    p AS (SELECT "table", column_name, prefix, confidence, CASE WHEN count(*) OVER (PARTITION BY prefix, kind) >= 3 THEN kind ELSE 'main' END AS part FROM k)"""


@R.add("sub_entities", _PARTS + " SELECT * FROM p")
def sub_entities(spark, sf_dir):
    return normalize.sub_entities(column_groups(spark, sf_dir))


@R.add(
    "entity_keys",
    _PARTS
    + f""", f AS (SELECT *, contains(column_name, 'recid') AS profiled FROM p)
    SELECT "table", prefix, part, count(*) AS n_columns,
        coalesce(min(column_name) FILTER (profiled AND part = 'main'), min(column_name) FILTER (part = 'main' AND regexp_matches(lower(column_name), '({"|".join(normalize.KEY_ENDINGS)})$'))) AS key_column,
        round(least(1.0::DOUBLE, max(confidence) + count(*) FILTER (profiled) / count(*)::DOUBLE * 0.1), 4) AS confidence FROM f GROUP BY 1, 2, 3""",
)
def entity_keys(spark, sf_dir):
    profiled = _flat(spark).where("contains(column_name, 'recid')").withColumn("unique_percent", F.lit(100.0))
    return normalize.entity_keys(sub_entities(spark, sf_dir), profiled)


@R.add(
    "normalization_plan",
    _PARTS
    + f""", e AS (SELECT "table", prefix, part, count(*) AS n_columns,
        coalesce(min(column_name) FILTER (part = 'main' AND contains(column_name, 'recid')), min(column_name) FILTER (part = 'main' AND regexp_matches(lower(column_name), '({"|".join(normalize.KEY_ENDINGS)})$'))) AS key_column FROM p GROUP BY 1, 2, 3),
    based AS (SELECT *, regexp_replace(CASE WHEN prefix <> '' THEN prefix ELSE "table" END, 's+$', '') AS base FROM e),
    r AS (SELECT *, CASE WHEN part = 'main' THEN base ELSE base || '_' || part END AS entity, row_number() OVER (PARTITION BY "table" ORDER BY part <> 'main', n_columns DESC, prefix, part) AS nth FROM based),
    o AS (SELECT r."table", r.entity, CASE WHEN r.nth = 1 THEN 'primary' ELSE 'child' END AS role, coalesce(r.key_column, r.entity || '_id') AS key_column,
        CASE WHEN r.nth > 1 THEN f.entity END AS parent, CASE WHEN r.nth > 1 THEN f.base || '_id' END AS foreign_key FROM r JOIN r f ON f."table" = r."table" AND f.nth = 1
        UNION ALL SELECT "table", CASE WHEN contains(column_name, '_stat') THEN regexp_replace(CASE WHEN prefix <> '' THEN prefix ELSE "table" END, 's+$', '') || '_status'
            ELSE regexp_replace(lower(column_name), '^[a-z]{{2,4}}_', '') || '_lookup' END, 'lookup', 'code', NULL, NULL FROM p WHERE regexp_matches(column_name, '_(stat|zip)'))
    SELECT *, row_number() OVER (PARTITION BY "table" ORDER BY CASE role WHEN 'lookup' THEN 1 WHEN 'primary' THEN 2 ELSE 3 END, entity)::INTEGER AS position FROM o""",
)
def normalization_plan(spark, sf_dir):
    return normalize.normalization_plan(entity_keys(spark, sf_dir), sub_entities(spark, sf_dir).where("column_name RLIKE '_(stat|zip)'"))


_SCHEMA_NAMES = ", ".join(map(str, names.SCHEMA_NAMES.items()))


@R.add(
    "modern_column_names",
    f"""WITH {ctes("names", "terms")}, known AS (SELECT * FROM (VALUES {_SCHEMA_NAMES}) AS v(short, wide)),
    a AS (SELECT source, modern, list_filter(regexp_split_to_array(lower(term), '\\s+'), lambda w: w <> '') AS w, regexp_replace(lower(source), '^[a-z]{{2,4}}_', '') AS short,
        regexp_replace(source, '^[a-zA-Z]{{2,4}}_', '') AS bare FROM names LEFT JOIN terms USING (source)),
    b AS (SELECT *, nullif(regexp_replace(array_to_string(CASE WHEN len(w) > 2 THEN w[2:] WHEN len(w) = 2 THEN w END, '_'), '[^a-z0-9_]', '', 'g'), '') AS said,
        lower(trim(regexp_replace(regexp_replace(regexp_replace(bare, '([A-Z])', '_\\1', 'g'), '[^a-zA-Z0-9]', '_', 'g'), '_+', '_', 'g'), '_')) AS snake FROM a)
    SELECT source, coalesce(nullif(modern, ''), said, wide, nullif(snake, ''), 'column') AS name FROM b LEFT JOIN known USING (short)""",
)
def modern_column_names(spark, sf_dir):
    rows = literal(spark, "names").join(literal(spark, "terms"), "source", "left")
    return rows.select("source", names.modernized(F.col("source"), F.col("term"), F.col("modern")).alias("name"))


_FLAGS = """flags AS (SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'y' ELSE 'N' END AS f1, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'TRUE' END AS f2, o_orderstatus AS f3 FROM orders),
    truths AS (SELECT unnest([1, 2, 3]) AS i, unnest([bool_and(upper(f1) IN ('Y', 'N')), bool_and(upper(f2) IN ('TRUE', 'FALSE')), bool_and(upper(f3) IN ('Y', 'N', 'T', 'F'))]) AS fits FROM flags)"""


def _issues(spark, sf_dir):
    key = F.col("o_orderkey")
    flags = table(spark, sf_dir, "orders").select(F.when(key % 2 == 0, "y").otherwise("N").alias("f1"), F.when(key % 3 != 0, "TRUE").alias("f2"), F.col("o_orderstatus").alias("f3"))
    booleans = transforms.boolean_columns(flags).withColumn("table", F.lit("orders"))
    return transforms.transform_issues(literal(spark, "transform_scripts"), literal(spark, "transform_mappings"), booleans)


_ISSUES = f"""WITH {ctes("transform_scripts", "transform_mappings")}, {_FLAGS}, j AS (SELECT * FROM transform_mappings JOIN transform_scripts USING ("table")),
    i AS (SELECT "table", 'archived_column_in_transform' AS test, 'HIGH' AS severity, source AS subject FROM j WHERE type IN ('archived', 'removed') AND target <> '' AND contains(script, target)
    UNION ALL SELECT "table", 'transform_source_missing', 'MEDIUM', source FROM j WHERE type = 'transform' AND target <> '' AND NOT contains(script, source)
    UNION ALL SELECT "table", 'pii_hash_missing', 'HIGH', source FROM j WHERE type = 'transform' AND regexp_matches(lower(rationale), 'sha|hash') AND NOT regexp_matches(lower(script), 'sha256|encode')
    UNION ALL SELECT "table", 'transform_not_empty', 'HIGH', "table" FROM transform_scripts WHERE trim(script) = ''
    UNION ALL SELECT "table", 'boolean_conversion_missing', 'LOW', 'f' || t.i FROM truths t, transform_scripts WHERE fits AND "table" = 'orders' AND NOT regexp_matches(upper(script), 'CASE WHEN|BOOLEAN'))"""


@R.add("transform_issues", _ISSUES + " SELECT * FROM i")
def transform_issues(spark, sf_dir):
    return _issues(spark, sf_dir)


@R.add(
    "transform_penalty",
    _ISSUES + """, t AS (SELECT count(*) AS n_issues, least(20, sum(CASE severity WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 1 ELSE 0 END))::BIGINT AS penalty FROM i)
    SELECT *, CASE WHEN n_issues = 0 THEN 'PASS' WHEN penalty >= 10 THEN 'FAIL' ELSE 'WARN' END AS status FROM t""",
)
def transform_penalty(spark, sf_dir):
    return transforms.transform_penalty(_issues(spark, sf_dir))


_LEGACY = {"o_orderkey": "NUMERIC(18)", "o_totalprice": "NUMBER(12,2)", "o_orderdate": "TIMESTAMP", "o_orderstatus": "varchar(40)", "o_custkey": "bigint", "big": "decimal", "flag": "char(1)", "seen_dt": "timestamp"}


@R.add(
    "optimize_types",
    """WITH x AS (SELECT o_orderkey, o_totalprice, o_orderstatus, o_orderkey * 10000000000 AS big FROM orders)
    SELECT 'o_orderkey' AS column_name, CASE WHEN min(o_orderkey) >= -2147483648 AND max(o_orderkey) <= 2147483647 THEN 'INTEGER' ELSE 'BIGINT' END AS optimized FROM x
    UNION ALL SELECT 'o_totalprice', CASE WHEN min(o_totalprice) = floor(min(o_totalprice)) AND max(o_totalprice) = floor(max(o_totalprice)) THEN 'INTEGER' ELSE 'NUMBER(12,2)' END FROM x
    UNION ALL SELECT 'big', CASE WHEN max(big) <= 2147483647 THEN 'INTEGER' ELSE 'BIGINT' END FROM x
    UNION ALL SELECT 'o_orderstatus', 'VARCHAR(' || greatest(10, CAST(ceil(floor(max(length(o_orderstatus)) * 1.5) / 10) * 10 AS BIGINT)) || ')' FROM x
    UNION ALL SELECT c, CASE WHEN regexp_matches(c, '_date|_dt|dob|birth') THEN 'DATE' ELSE 'TIMESTAMPTZ' END FROM (VALUES ('o_orderdate'), ('seen_dt')) AS v(c)
    UNION ALL SELECT 'flag', CASE WHEN list_sort(list(DISTINCT CASE WHEN o_orderkey % 2 = 0 THEN 'Y' ELSE 'N' END)) = ['N', 'Y'] THEN 'BOOLEAN' ELSE 'VARCHAR(10)' END FROM x
    UNION ALL SELECT 'o_custkey', 'BIGINT'""",
)
def optimize_types(spark, sf_dir):
    key = F.col("o_orderkey")
    df = table(spark, sf_dir, "orders").select(
        key, "o_totalprice", "o_orderdate", "o_orderstatus", "o_custkey", (key.cast("long") * 10_000_000_000).alias("big"), F.when(key % 2 == 0, "y").otherwise("n").alias("flag"), F.col("o_orderdate").alias("seen_dt")
    )
    types = spark.createDataFrame(list(_LEGACY.items()), "column_name string, legacy_type string")
    found = inference.with_values(profile.column_profile(df), profile.value_frequencies(df)).join(types, "column_name")
    found = found.join(inference.numeric_bounds(df, ["o_orderkey", "o_totalprice", "big"]), "column_name", "left")
    kind = inference.optimize_type(*(F.col(c) for c in ("column_name", "legacy_type", "values", "distinct_count", "max_length", "low", "high")))
    return found.select("column_name", kind.alias("optimized"))


@R.add(
    "pii_action",
    f"""WITH {ctes("glossary", "mappings")}, j AS (SELECT g.name, m.type, g.description FROM glossary g LEFT JOIN mappings m ON m."table" = g."table" AND m.source = g.name WHERE g.pii)
    SELECT name, CASE WHEN type = 'archived' THEN 'archive' """
    + " ".join(f"WHEN contains(upper(name), '{k}') THEN '{v}'" for k, v in inference.PII_ACTIONS.items())
    + " END AS action FROM j",
)
def pii_action(spark, sf_dir):
    known = literal(spark, "mappings").select("table", F.col("source").alias("name"), "type")
    rows = literal(spark, "glossary").where("pii").join(known, ["table", "name"], "left")
    return rows.select("name", inference.pii_action(F.col("type"), F.lit(""), F.upper("name")).alias("action"))


@R.add("unmapped_legacy", f"""WITH {ctes("mappings", "glossary")} SELECT "table", name FROM glossary g WHERE NOT EXISTS (SELECT 1 FROM mappings m WHERE m."table" = g."table" AND m.source = g.name AND m.type <> 'pending')""")
def unmapped_legacy(spark, sf_dir):
    known = literal(spark, "mappings").where("type <> 'pending'").select("table", F.col("source").alias("name"))
    return literal(spark, "glossary").join(known, ["table", "name"], "left_anti").select("table", "name")


@R.add("review_notes", f"""WITH {ctes("scripts")}, l AS (SELECT name, unnest(string_split(script, chr(10))) AS line FROM scripts)
    SELECT name, regexp_extract(line, '-- *(TODO|Review|REVIEW|WARNING|FIXME)', 1) AS kind, trim(regexp_extract(line, '-- *(.*)$', 1)) AS note FROM l WHERE regexp_matches(line, '-- *(TODO|Review|REVIEW|WARNING|FIXME)')""")
def review_notes(spark, sf_dir):
    return legacy_code.review_notes(literal(spark, "scripts"))


_SAMPLE = "SELECT o_orderkey FROM orders WHERE o_orderkey IS NOT NULL ORDER BY md5(CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT 2000"
_TWO = [("o_custkey", "customer_id"), ("o_orderstatus", "order_status")]


@R.add(
    "sample_differences",
    f"""WITH {MODERN}, c AS (SELECT order_id, CASE WHEN order_id % 60 = 0 THEN customer_id + 1 ELSE customer_id END AS customer_id, CASE WHEN order_id % 90 = 0 THEN '?' ELSE order_status END AS order_status FROM m_orders),
    j AS (SELECT CAST(o_orderkey AS VARCHAR) AS key, CAST(o_custkey AS VARCHAR) AS a1, CAST(customer_id AS VARCHAR) AS b1, o_orderstatus AS a2, order_status AS b2
        FROM ({_SAMPLE}) JOIN orders USING (o_orderkey) JOIN c ON order_id = o_orderkey),
    d AS (SELECT * FROM j WHERE a1 <> b1 OR lower(trim(a2)) <> lower(trim(b2)) ORDER BY key LIMIT 10)
    SELECT key, 'customer_id' AS column_name, a1 AS legacy, b1 AS modern FROM d WHERE a1 <> b1
    UNION ALL SELECT key, 'order_status', a2, b2 FROM d WHERE lower(trim(a2)) <> lower(trim(b2))""",
)
def sample_differences(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    key = F.col("order_id")
    changed = modern_orders(orders).withColumns(
        {"customer_id": F.when(key % 60 == 0, F.col("customer_id") + 1).otherwise(F.col("customer_id")), "order_status": F.when(key % 90 == 0, "?").otherwise(F.col("order_status"))}
    )
    # each key comes twice on both sides: it is matched once
    return comparing.sample_differences(orders.union(orders), changed.union(changed), ("o_orderkey", "order_id"), _TWO, n=2000)


@R.add(
    "observe",
    f"""WITH {MODERN}, n AS (SELECT (SELECT count(*) FROM m_orders) AS n, (SELECT count(*) FROM orders) AS base, (SELECT max(ordered_at) FROM m_orders) AS latest,
        (SELECT count(DISTINCT customer_id) FROM m_orders WHERE customer_id NOT IN (SELECT customer_id FROM m_customer)) AS lost),
    h AS (SELECT *, round(abs(n - base) * 100.0::DOUBLE / base, 2) AS deviation, (epoch(TIMESTAMP '2026-01-01 00:00:00')::BIGINT - floor(epoch(latest))::BIGINT) / 3600.0::DOUBLE AS hours FROM n)
    SELECT 'schema_drift' AS "check", 'HIGH' AS severity, true AS alert FROM h UNION ALL SELECT 'volume_anomaly', 'MEDIUM', deviation > 30 FROM h
    UNION ALL SELECT 'freshness', 'MEDIUM', hours > 24 FROM h UNION ALL SELECT 'fk_integrity', 'HIGH', lost > 0 FROM h""",
)
def observe(spark, sf_dir):
    from migcheck.queries.common import modern_customer

    orders = table(spark, sf_dir, "orders")
    now = modern_orders(orders).withColumnRenamed("ordered_at", "updated_at")
    before = orders.select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"))
    parents = {"orders": [("customer_id", modern_customer(table(spark, sf_dir, "customer")), "customer_id")]}
    found = observer.observe({"orders": now}, observer.snapshot({"orders": before}), "2026-01-01 00:00:00", references=parents)
    return found.select("check", "severity", "alert")


@R.add(
    "vector_above",
    """WITH s AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_inner_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 4) AS score
    FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s WHERE score > 0.3)
    SELECT * FROM r WHERE rank <= 3""",
)
def vector_above(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return vector.top_similar(vectors, vectors.where("vec_id % 50 = 0"), 3, above=0.3)
