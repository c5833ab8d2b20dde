"""Profiles, inference, data quality and monitoring of the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from migcheck.functions import compare, names
from migcheck.operators import governance, inference, matching, profile, reshape, vector
from migcheck.operators.schema import schema_of
from migcheck.plans import monitor
from migcheck.queries.common import Registry, ctes, literal, table
from migcheck.streaming import events as stream

R = Registry()

_CUSTOMER = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
_ORDERS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


def _profile_sql(name: str, columns: list[str]) -> str:
    parts = [
        f"""SELECT '{name}' AS "table", '{c}' AS column_name, count(*) AS row_count, count(*) - count({c}) AS null_count,
        round((count(*) - count({c})) * 100.0::DOUBLE / count(*), 2) AS null_percent, count(DISTINCT {c}) AS distinct_count,
        round(count(DISTINCT {c}) * 100.0::DOUBLE / count(*), 2) AS unique_percent, min(CAST({c} AS VARCHAR)) AS min_value, max(CAST({c} AS VARCHAR)) AS max_value,
        max(length(CAST({c} AS VARCHAR)))::BIGINT AS max_length FROM {name}"""
        for c in columns
    ]
    return " UNION ALL ".join(parts)


def _freq_sql(name: str, columns: list[str]) -> str:
    parts = [f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, count(*) AS n FROM {name} WHERE {c} IS NOT NULL GROUP BY 2" for c in columns]
    return f"""SELECT column_name, value, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value)::INTEGER AS rank
        FROM ({" UNION ALL ".join(parts)}) WHERE value <> '') WHERE rank <= 10"""


@R.add("table_counts", " UNION ALL ".join(f"""SELECT '{t}' AS "table", count(*) AS n FROM {t}""" for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")))
def table_counts(spark, sf_dir):
    out = None
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        part = table(spark, sf_dir, name).agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n")
        out = part if out is None else out.union(part)
    return out


_NULLED = """nulled AS (SELECT event_id, user_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_type END AS event_type,
    CASE WHEN event_id % 5 = 0 THEN '' WHEN event_id % 3 = 0 THEN NULL ELSE props END AS props FROM events)"""


def _nulled(spark, sf_dir):
    key = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        key,
        "user_id",
        F.when(key % 7 != 0, F.col("event_type")).alias("event_type"),
        F.when(key % 5 == 0, "").when(key % 3 != 0, F.col("props")).alias("props"),
    )


def _null_sql(condition: str) -> str:
    parts = [f"SELECT '{c}' AS column_name, count(*) FILTER ({condition.format(c=c)}) * 100.0::DOUBLE / count(*) AS null_percent FROM nulled" for c in ("event_id", "event_type", "props")]
    return f"WITH {_NULLED} " + " UNION ALL ".join(parts)


@R.add("null_percentage", f"SELECT column_name, round(null_percent, 6) AS null_percent FROM ({_null_sql('{c} IS NULL')})")
def null_percentage(spark, sf_dir):
    found = profile.null_percentages(_nulled(spark, sf_dir), ["event_id", "event_type", "props"])
    return found.select("column_name", F.round("null_percent", 6).alias("null_percent"))


@R.add("null_or_empty_percentage", f"SELECT column_name, round(null_percent, 2) AS null_percent FROM ({_null_sql(chr(123) + 'c' + chr(125) + ' IS NULL OR CAST(' + chr(123) + 'c' + chr(125) + chr(32) + 'AS VARCHAR) = ' + chr(39) * 2)})")
def null_or_empty_percentage(spark, sf_dir):
    found = profile.null_percentages(_nulled(spark, sf_dir), ["event_id", "event_type", "props"], empty_is_null=True)
    return found.select("column_name", F.round("null_percent", 2).alias("null_percent"))


@R.add("null_violations", f"SELECT column_name, round(null_percent, 2) AS null_percent FROM ({_null_sql('{c} IS NULL')}) WHERE null_percent > 10")
def null_violations(spark, sf_dir):
    return governance.null_violations(_nulled(spark, sf_dir).select("event_id", "event_type", "props"), 10)


@R.add(
    "null_report",
    f"SELECT column_name, round(null_percent, 2) AS null_percent, CASE WHEN null_percent > 20 THEN 'VIOLATION' ELSE 'PASS' END AS status FROM ({_null_sql('{c} IS NULL')})",
)
def null_report(spark, sf_dir):
    found = profile.null_percentages(_nulled(spark, sf_dir), ["event_id", "event_type", "props"])
    status = F.when(F.col("null_percent") > 20, "VIOLATION").otherwise("PASS")
    return found.select("column_name", F.round("null_percent", 2).alias("null_percent"), status.alias("status"))


@R.add("duplicate_count", "SELECT count(*) AS duplicate_count FROM (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) > 1)")
def duplicate_count(spark, sf_dir):
    return profile.duplicate_count(table(spark, sf_dir, "orders"), "o_custkey")


@R.add("distinct_count", "SELECT count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_returnflag) AS flags FROM lineitem")
def distinct_count(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").agg(
        F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_suppkey").alias("suppliers"), F.count_distinct("l_returnflag").alias("flags")
    )


@R.add("text_min_max", """SELECT min(CAST(l_orderkey AS VARCHAR)) AS low, max(CAST(l_orderkey AS VARCHAR)) AS high, max(length(CAST(l_orderkey AS VARCHAR)))::BIGINT AS longest FROM lineitem""")
def text_min_max(spark, sf_dir):
    text = F.col("l_orderkey").cast("string")
    return table(spark, sf_dir, "lineitem").agg(F.min(text).alias("low"), F.max(text).alias("high"), F.max(F.length(text)).cast("long").alias("longest"))


@R.add("value_frequencies", _freq_sql("orders", ["o_orderpriority", "o_orderstatus", "o_custkey"]))
def value_frequencies(spark, sf_dir):
    return profile.value_frequencies(table(spark, sf_dir, "orders"), ["o_orderpriority", "o_orderstatus", "o_custkey"])


@R.add("column_profile", _profile_sql("customer", _CUSTOMER) + " UNION ALL " + _profile_sql("orders", _ORDERS))
def column_profile(spark, sf_dir):
    one = profile.column_profile(table(spark, sf_dir, "customer")).withColumn("table", F.lit("customer"))
    return one.union(profile.column_profile(table(spark, sf_dir, "orders")).withColumn("table", F.lit("orders")))


@R.add("baseline", f"""SELECT "table", column_name, row_count, null_percent, distinct_count FROM ({_profile_sql("customer", _CUSTOMER)} UNION ALL {_profile_sql("orders", _ORDERS)})""")
def baseline(spark, sf_dir):
    return monitor.baseline({"customer": (table(spark, sf_dir, "customer"), _CUSTOMER), "orders": (table(spark, sf_dir, "orders"), _ORDERS)})


@R.add("extreme_outlier", """SELECT round(avg(l_extendedprice), 4) AS mean, round(stddev_samp(l_extendedprice), 4) AS stddev, max(l_extendedprice) AS largest,
    max(l_extendedprice) > avg(l_extendedprice) + 5 * stddev_samp(l_extendedprice) AS is_extreme FROM lineitem""")
def extreme_outlier(spark, sf_dir):
    return profile.extreme_outlier(table(spark, sf_dir, "lineitem"), "l_extendedprice")


_INFER = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "flag", "order_date"]


def _infer_input(spark, sf_dir):
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority",
        F.when(key % 2 == 0, "Y").otherwise("N").alias("flag"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("order_date"),
    )


_INFER_CTE = """x AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, CASE WHEN o_orderkey % 2 = 0 THEN 'Y' ELSE 'N' END AS flag,
    strftime(o_orderdate, '%Y-%m-%d') AS order_date FROM orders)"""


def _infer_sql() -> str:
    freq, prof = _freq_sql("x", _INFER), _profile_sql("x", _INFER)
    return f"""WITH {_INFER_CTE}, f AS ({freq}), v AS (SELECT column_name, list(value ORDER BY rank) AS vals FROM f GROUP BY 1), p AS ({prof}), j AS (SELECT * FROM p JOIN v USING (column_name))"""


@R.add(
    "infer_types",
    _infer_sql()
    + """ SELECT column_name, CASE WHEN distinct_count = 2 AND list_sort(vals) = ['N', 'Y'] THEN 'BOOLEAN'
        WHEN column_name LIKE '%date%' AND length(vals[1]) >= 8 AND regexp_matches(vals[1], '^[0-9]{4}') THEN 'DATE'
        WHEN distinct_count > 2 AND len(list_filter(vals, lambda v: NOT regexp_matches(v, '^[0-9]+$'))) = 0
            THEN CASE WHEN greatest(length(min_value), length(max_value)) > 9 THEN 'BIGINT' ELSE 'INTEGER' END
        ELSE 'VARCHAR(' || greatest(10, CAST(ceil(floor(max_length * 1.5) / 10) * 10 AS BIGINT)) || ')' END AS inferred FROM j""",
)
def infer_types(spark, sf_dir):
    df = _infer_input(spark, sf_dir)
    found = inference.with_values(profile.column_profile(df), profile.value_frequencies(df))
    kind = inference.infer_type(F.col("column_name"), F.col("values"), F.col("distinct_count"), F.col("max_length"), F.col("min_value"), F.col("max_value"))
    return found.select("column_name", kind.alias("inferred"))


@R.add(
    "infer_constraints",
    _infer_sql()
    + """ SELECT column_name, null_percent = 0 AS not_null, unique_percent >= 99.9 AND regexp_matches(column_name, '(_id|key|_hash|_code)$') AS is_unique,
        CASE WHEN distinct_count BETWEEN 3 AND 10 AND len(list_filter(vals, lambda v: NOT regexp_matches(v, '^[-0-9.]+$'))) = len(vals)
            THEN array_to_string(list_sort(vals), ',') END AS check_in FROM j""",
)
def infer_constraints(spark, sf_dir):
    df = _infer_input(spark, sf_dir)
    return inference.infer_constraints(inference.with_values(profile.column_profile(df), profile.value_frequencies(df)))


@R.add("lookup_candidates", _infer_sql() + """ SELECT column_name, distinct_count FROM p WHERE distinct_count BETWEEN 1 AND 20
    AND NOT regexp_matches(column_name, '(_id|key|_recid)$') AND (regexp_matches(column_name, 'stat|type|code|categ|class|flag') OR distinct_count <= 5)""")
def lookup_candidates(spark, sf_dir):
    return inference.lookup_candidates(profile.column_profile(_infer_input(spark, sf_dir)))


@R.add(
    "profile_risk",
    f"""WITH {_NULLED}, r AS ({" UNION ALL ".join(f"SELECT '{c}' AS column_name, round((count(*) - count({c})) * 100.0::DOUBLE / count(*), 2) AS p FROM nulled" for c in ("event_id", "event_type", "props"))})
    SELECT column_name, CASE WHEN column_name = 'event_type' AND p > 0 THEN 'null_in_not_null' WHEN p = 100 THEN 'all_null' ELSE 'mostly_null' END AS risk,
        CASE WHEN column_name = 'event_type' AND p > 0 THEN 'HIGH' WHEN p = 100 THEN 'LOW' ELSE 'MEDIUM' END AS severity FROM r
    WHERE (column_name = 'event_type' AND p > 0) OR p > 50""",
)
def profile_risk(spark, sf_dir):
    strict = spark.createDataFrame([("event_id",), ("event_type",)], "column_name string")
    return inference.profile_risks(profile.column_profile(_nulled(spark, sf_dir), ["event_id", "event_type", "props"]), strict)


@R.add("completeness", f"""WITH {_NULLED}, r AS ({_null_sql("{c} IS NULL").partition(") SELECT")[1].replace(")", "", 1) + _null_sql("{c} IS NULL").partition(") SELECT")[2]})
    SELECT 'events' AS "table", round(greatest(0.0, 100 - avg(round(null_percent, 2)))::DOUBLE, 2) AS completeness FROM r""")
def completeness(spark, sf_dir):
    found = profile.column_profile(_nulled(spark, sf_dir), ["event_id", "event_type", "props"])
    return monitor.completeness(found.withColumn("table", F.lit("events")))


@R.add("rationalize_flat", f"""WITH {_NULLED}, r AS ({_null_sql("{c} IS NULL").partition(") SELECT")[1].replace(")", "", 1) + _null_sql("{c} IS NULL").partition(") SELECT")[2]}),
    c AS (SELECT round(round(greatest(0.0, 100 - avg(round(null_percent, 2)))::DOUBLE, 2) * 0.5::DOUBLE + 50, 3) AS score FROM r)
    SELECT 'events' AS "table", score, CASE WHEN score >= 70 THEN 'migrate' WHEN score >= 40 THEN 'review' ELSE 'archive' END AS recommendation FROM c""")
def rationalize_flat(spark, sf_dir):
    found = completeness(spark, sf_dir).withColumn("score", F.round(F.col("completeness") * 0.5 + 50, 3))
    return found.select("table", "score", monitor.recommendation(F.col("score")).alias("recommendation"))


def _values(columns) -> str:
    return "(VALUES " + ", ".join(f"('{c}')" for c in columns) + ") AS v(column_name)"


_PERSONAL = f"len(list_filter({list(names.PII_KEYWORDS)}, lambda k: contains(lower(column_name), k))) > 0"


@R.add("pii_columns", f"SELECT column_name FROM {_values(['c_custkey', 'c_name', 'c_phone_no', 's_address', 'zip', 'c_tier'])} WHERE {_PERSONAL}")
def pii_columns(spark, sf_dir):
    key = F.col("c_custkey")
    df = table(spark, sf_dir, "customer").select(key, "c_name", key.alias("c_phone_no"), key.alias("s_address"), key.alias("zip"), key.alias("c_tier"))
    return governance.pii_columns(schema_of(spark, df))


_SPELLED = ["good_name", "BadName", "also-bad", "ALLCAPS", "has spaces", "snake_case_123"]


@R.add("naming_violations", f"SELECT column_name FROM {_values(_SPELLED)} WHERE NOT regexp_matches(column_name, '^[a-z][a-z0-9_]*$')")
def naming_violations(spark, sf_dir):
    return governance.naming_violations(spark.createDataFrame([(c,) for c in _SPELLED], "column_name string"))


_GOVERNED = ["event_id", "event_type", "props", "email", "ssn", "bank_no", "BadName"]


@R.add(
    "governance",
    f"""WITH {_NULLED}, n AS (SELECT count(*) FILTER (null_percent > 10) AS nulls FROM ({_null_sql("{c} IS NULL").partition(") SELECT")[1].replace(")", "", 1) + _null_sql("{c} IS NULL").partition(") SELECT")[2]}))
    , s AS (SELECT count(*) FILTER ({_PERSONAL} AND column_name <> 'ssn') AS unhandled, count(*) FILTER ({_PERSONAL} AND column_name = 'ssn') AS handled,
        count(*) FILTER (NOT regexp_matches(column_name, '^[a-z][a-z0-9_]*$')) AS naming FROM {_values(_GOVERNED)}),
    m AS (SELECT count(*) AS missing FROM (VALUES ('event_id'), ('created_at')) AS v(column_name) WHERE column_name NOT IN (SELECT column_name FROM (DESCRIBE SELECT event_id, event_type, props FROM events))),
    t AS (SELECT *, (100 - least(5 * unhandled, 30) - least(handled, 10) - least(2 * naming, 10) - least(10 * missing, 30) - least(3 * nulls, 15))::BIGINT AS score FROM s, n, m)
    SELECT *, CASE WHEN score = 100 THEN 'PASS' ELSE 'WARN' END AS status FROM t""",
)
def governance_query(spark, sf_dir):
    df = _nulled(spark, sf_dir).select("event_id", "event_type", "props")
    schema = spark.createDataFrame([(c,) for c in _GOVERNED], "column_name string")
    handled = spark.createDataFrame([("ssn",)], "column_name string")
    return governance.governance(df, schema, handled, ["event_id", "created_at"], 10)


@R.add("dq_cross_field", "SELECT 'error_with_value' AS rule, count(*) FILTER (event_type = 'purchase' AND value < 5) AS n FROM events UNION ALL SELECT 'no_user', count(*) FILTER (user_id IS NULL) FROM events")
def dq_cross_field(spark, sf_dir):
    return governance.broken_rules(table(spark, sf_dir, "events"), {"error_with_value": "event_type = 'purchase' AND value < 5", "no_user": "user_id IS NULL"})


@R.add(
    "encoding_issues",
    """WITH d AS (SELECT CASE WHEN c_custkey % 11 = 0 THEN c_name || chr(195) || chr(169) WHEN c_custkey % 13 = 0 THEN c_name || chr(65533) ELSE c_name END AS name,
        CASE WHEN c_custkey % 19 = 0 THEN chr(226) || chr(128) || chr(153) ELSE c_mktsegment END AS segment FROM customer)
    SELECT 'name' AS column_name, 'mojibake' AS kind, count(*) AS n FROM d WHERE regexp_matches(name, 'Ã[\\x{80}-\\x{BF}]')
    UNION ALL SELECT 'name', 'replacement', count(*) FROM d WHERE contains(name, chr(65533))
    UNION ALL SELECT 'segment', 'mojibake', count(*) FROM d WHERE contains(segment, chr(226) || chr(128))""",
)
def encoding_issues(spark, sf_dir):
    key = F.col("c_custkey")
    name = F.when(key % 11 == 0, F.concat("c_name", F.lit("Ã©"))).when(key % 13 == 0, F.concat("c_name", F.lit("�"))).otherwise(F.col("c_name"))
    segment = F.when(key % 19 == 0, F.lit("â\u0080\u0099")).otherwise(F.col("c_mktsegment"))
    return governance.encoding_issues(table(spark, sf_dir, "customer").select(name.alias("name"), segment.alias("segment")), ["name", "segment"])


@R.add(
    "parse_dates",
    """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS parsed FROM orders WHERE o_orderkey % 4 < 3
    UNION ALL SELECT o_orderkey, NULL FROM orders WHERE o_orderkey % 4 = 3""",
)
def parse_dates(spark, sf_dir):
    key, day = F.col("o_orderkey"), F.col("o_orderdate")
    text = (
        F.when(key % 4 == 0, F.date_format(day, "yyyy-MM-dd")).when(key % 4 == 1, F.date_format(day, "MM/dd/yy"))
        .when(key % 4 == 2, F.date_format(day, "MMMM dd, yyyy")).otherwise(F.date_format(day, "dd.MM.yyyy"))
    )
    return table(spark, sf_dir, "orders").select(key, compare.parse_date(text).alias("parsed"))


@R.add("normalize_phone", "SELECT c_custkey, regexp_replace('(' || c_custkey || ') ' || c_name, '[^0-9]', '', 'g') AS digits FROM customer")
def normalize_phone(spark, sf_dir):
    text = F.concat(F.lit("("), F.col("c_custkey").cast("string"), F.lit(") "), F.col("c_name"))
    return table(spark, sf_dir, "customer").select("c_custkey", compare.digits_only(text).alias("digits"))


@R.add("pii_hash", "SELECT c_custkey, sha256(c_name) AS hash FROM customer")
def pii_hash(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", reshape.hashed(F.col("c_name")).alias("hash"))


@R.add("volume_anomaly", """SELECT event_type, count(*) AS n, round(abs(count(*) - 2000) * 100.0::DOUBLE / 2000, 2) AS deviation, abs(count(*) - 2000) * 100.0 / 2000 > 30 AS is_anomaly
    FROM events GROUP BY event_type""")
def volume_anomaly(spark, sf_dir):
    counted = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    deviation, anomaly = monitor.volume_anomaly(F.col("n"), F.lit(2000))
    return counted.select("event_type", "n", deviation.alias("deviation"), anomaly.alias("is_anomaly"))


@R.add("freshness", """SELECT max(ts) AS latest, round((epoch(TIMESTAMP '2026-01-01 00:00:00')::BIGINT - floor(epoch(max(ts)))::BIGINT) / 3600.0::DOUBLE, 2) AS age_hours,
    (epoch(TIMESTAMP '2026-01-01 00:00:00')::BIGINT - floor(epoch(max(ts)))::BIGINT) / 3600.0 > 24 AS stale FROM events""")
def freshness(spark, sf_dir):
    return monitor.freshness(table(spark, sf_dir, "events"), "ts", "2026-01-01 00:00:00", 24)


@R.add(
    "vector_topk",
    """WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0)
    SELECT vec_id, round(list_inner_product(embedding::DOUBLE[], e::DOUBLE[]), 4) AS score FROM embeddings, q ORDER BY score DESC, vec_id LIMIT 10""",
)
def vector_topk(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return vector.top_similar(vectors, vectors.where("vec_id = 0"), 10).select("vec_id", "score")


@R.add(
    "vector_topk_many",
    """WITH s AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_inner_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 4) AS score
    FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s) SELECT * FROM r WHERE rank <= 10""",
)
def vector_topk_many(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return vector.top_similar(vectors, vectors.where("vec_id % 50 = 0"), 10)


@R.add("normalize_groups", """WITH c AS (SELECT unnest(['c_custkey', 'c_name', 'c_acctbal', 'o_orderkey', 'o_custkey', 'o_status', 'ps_qty', 'plain']) AS column_name),
    p AS (SELECT *, regexp_extract(column_name, '^([a-z]{1,4})_', 1) AS prefix FROM c), s AS (SELECT prefix, count(*) AS n FROM p GROUP BY 1),
    k AS (SELECT column_name, CASE WHEN n >= 3 THEN prefix ELSE '' END AS prefix FROM p JOIN s USING (prefix))
    SELECT prefix, count(*) AS n_columns, string_agg(column_name, ',' ORDER BY column_name) AS columns FROM k GROUP BY prefix""")
def normalize_groups(spark, sf_dir):
    columns = ["c_custkey", "c_name", "c_acctbal", "o_orderkey", "o_custkey", "o_status", "ps_qty", "plain"]
    return reshape.prefix_groups(spark.createDataFrame([(c,) for c in columns], "column_name string"))


@R.add("tumbling_events", """SELECT date_trunc('hour', ts)::TIMESTAMP AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2""")
def tumbling_events(spark, sf_dir):
    found = stream.tumbling_counts(table(spark, sf_dir, "events"))
    return found.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


_NAMES = ctes("names")


_SHORT = "regexp_replace(lower(source), '^[a-z]{2,3}_(.)', '\\1')"


@R.add(
    "expand_abbrev",
    f"WITH {_NAMES}, s AS (SELECT source, {_SHORT} AS short FROM names), a AS (SELECT * FROM (VALUES {', '.join(map(str, names.ABBREVIATIONS.items()))}) AS v(short, wide)) "
    f"SELECT source, CASE WHEN short IN {names.RECORD_IDS} THEN '_record_id' ELSE coalesce(wide, short) END AS expanded FROM s LEFT JOIN a USING (short)",
)
def expand_abbrev(spark, sf_dir):
    return literal(spark, "names").select("source", names.expand(F.col("source")).alias("expanded"))


@R.add("match_columns", None)
def match_columns(spark, sf_dir):
    return matching.match_columns(literal(spark, "names"), literal(spark, "modern_names"))


@R.add(
    "infer_description",
    "WITH " + _NAMES + " SELECT source, CASE " + " ".join(f"WHEN contains(lower(source), '{p}') THEN '{d} for ' || source" for p, d, _ in names.DESCRIPTIONS)
    + " ELSE upper(data_type[1]) || data_type[2:] || ' value for ' || source END AS description, CASE "
    + " ".join(f"WHEN contains(lower(source), '{p}') THEN {c}::DOUBLE" for p, _, c in names.DESCRIPTIONS) + " ELSE 0.3::DOUBLE END AS confidence FROM names",
)
def infer_description(spark, sf_dir):
    text, sure = names.described(F.col("source"), F.col("data_type"))
    return literal(spark, "names").select("source", text.alias("description"), sure.alias("confidence"))


@R.add(
    "snake_case",
    f"""WITH {_NAMES}, a AS (SELECT source, regexp_replace(source, '^[a-zA-Z]{{2,4}}_', '') AS s FROM names),
    b AS (SELECT source, lower(trim(regexp_replace(regexp_replace(regexp_replace(s, '([A-Z])', '_\\1', 'g'), '[^a-zA-Z0-9]', '_', 'g'), '_+', '_', 'g'), '_')) AS s FROM a)
    SELECT source, CASE WHEN s = '' THEN 'column' ELSE s END AS name FROM b""",
)
def snake_case(spark, sf_dir):
    return literal(spark, "names").select("source", names.snake_case(F.col("source")).alias("name"))


@R.add("clean_columns", f"WITH {_NAMES} SELECT source, lower(replace(trim(source), '-', '_')) AS name FROM names")
def clean_columns(spark, sf_dir):
    return literal(spark, "names").select("source", names.clean_name(F.col("source")).alias("name"))
