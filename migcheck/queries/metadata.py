"""Scores, run history and rollups over metadata tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from migcheck.functions import names, types
from migcheck.operators import governance, legacy_code, matching
from migcheck.plans import loading, monitor, runs, scoring
from migcheck.queries.common import Registry, ctes, literal, table

R = Registry()

_LIGHT = "CASE WHEN {s} >= 90 THEN 'GREEN' WHEN {s} >= 70 THEN 'YELLOW' ELSE 'RED' END"


_PENALTIES = "pen AS (SELECT * FROM (VALUES " + ", ".join(map(str, scoring.PENALTIES)) + ") AS v(target, structure_penalty, integrity_penalty, governance_penalty))"
_ALL_TARGETS = f"""WITH {ctes("components")}, {_PENALTIES}, s AS (SELECT *, round((greatest(0, structure - structure_penalty) * 0.4::DOUBLE + greatest(0, integrity - integrity_penalty) * 0.4::DOUBLE
    + greatest(0, governance - governance_penalty) * 0.2::DOUBLE), 2) AS score FROM components, pen)"""


@R.add("confidence", _ALL_TARGETS + f" SELECT dataset, score, {_LIGHT.format(s='score')} AS light FROM s WHERE target = 'postgres'")
def confidence(spark, sf_dir):
    return scoring.confidence(literal(spark, "components")).where("target = 'postgres'").select("dataset", "score", "light")


@R.add("confidence_all_targets", _ALL_TARGETS + f" SELECT dataset, target, score, {_LIGHT.format(s='score')} AS light FROM s")
def confidence_all_targets(spark, sf_dir):
    return scoring.confidence(literal(spark, "components")).select("dataset", "target", "score", "light")


@R.add(
    "score_rollup",
    f"""WITH {ctes("results")}, s AS (SELECT dataset, phase, count(*) FILTER (status <> 'PASS') AS n_findings, round(sum(penalty), 2) AS total_penalty,
        round(greatest(0.0::DOUBLE, 100 - sum(penalty)), 2) AS score FROM results GROUP BY 1, 2) SELECT *, {_LIGHT.format(s="score")} AS light FROM s""",
)
def score_rollup(spark, sf_dir):
    return scoring.score_rollup(literal(spark, "results"))


@R.add("pre_score_reweighted", f"WITH {ctes('components')} SELECT dataset, round(structure * 0.67::DOUBLE + governance * 0.33::DOUBLE, 2) AS score FROM components")
def pre_score_reweighted(spark, sf_dir):
    return literal(spark, "components").select("dataset", scoring.reweighted(F.col("structure"), F.col("governance")).alias("score"))


_LATEST = f"WITH {ctes('runs')}, latest AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY dataset, phase ORDER BY run_id DESC) = 1)"


@R.add("latest_runs", _LATEST + " SELECT * FROM latest")
def latest_runs(spark, sf_dir):
    return runs.latest_runs(literal(spark, "runs"))


@R.add(
    "proof_score",
    _LATEST
    + f""", b AS (SELECT dataset, max(score) FILTER (phase = 'pre') AS pre, max(score) FILTER (phase = 'post') AS post FROM latest GROUP BY 1)
    SELECT dataset, round((pre + post) / 2, 2) AS score, CASE WHEN pre IS NULL OR post IS NULL THEN 'INCOMPLETE' ELSE {_LIGHT.format(s="(pre + post) / 2")} END AS status FROM b""",
)
def proof_score(spark, sf_dir):
    return scoring.proof_score(runs.latest_runs(literal(spark, "runs")))


@R.add("run_status", f"WITH {ctes('runs')} SELECT * FROM runs ORDER BY run_id DESC LIMIT 5")
def run_status(spark, sf_dir):
    return runs.run_status(literal(spark, "runs"), 5)


@R.add(
    "lifecycle_score",
    f"""WITH {ctes("runs")} SELECT round(avg(score) FILTER (run_date = (SELECT max(run_date) FROM runs) AND score > 0), 2) AS latest_mean,
        round(avg(score) FILTER (phase = 'pre'), 2) AS pre_mean, round(avg(score) FILTER (phase = 'post' AND score > 0), 2) AS post_mean FROM runs""",
)
def lifecycle_score(spark, sf_dir):
    return runs.lifecycle_score(literal(spark, "runs"))


@R.add("mapping_type_counts", f"WITH {ctes('mappings')} SELECT type, count(*) AS n FROM mappings GROUP BY type")
def mapping_type_counts(spark, sf_dir):
    return runs.count_by(literal(spark, "mappings"), "type")


@R.add("mappings", f"WITH {ctes('mappings')} SELECT source, target, type, confidence FROM mappings WHERE type IN ('rename', 'transform') AND target IS NOT NULL")
def mappings(spark, sf_dir):
    return literal(spark, "mappings").where("type IN ('rename', 'transform') AND target IS NOT NULL").select("source", "target", "type", "confidence")


@R.add(
    "mapping_confidence",
    f"""WITH {ctes("mappings")} SELECT count(DISTINCT "table") AS n_tables, count(*) AS n_columns, count(*) FILTER (target IS NOT NULL) AS n_mapped, round(avg(confidence), 4) AS confidence FROM mappings""",
)
def mapping_confidence(spark, sf_dir):
    return literal(spark, "mappings").agg(
        F.count_distinct("table").alias("n_tables"), F.count("*").alias("n_columns"), F.count("target").alias("n_mapped"), F.round(F.avg("confidence"), 4).alias("confidence")
    )


@R.add("manual_changes", f"""WITH {ctes("mappings")} SELECT "table", source, target FROM mappings WHERE confidence >= 1 AND source <> target""")
def manual_changes(spark, sf_dir):
    return literal(spark, "mappings").where("confidence >= 1 AND source <> target").select("table", "source", "target")


_PII = f"""WITH {ctes("glossary", "mappings")}, h AS (SELECT DISTINCT "table", source FROM mappings WHERE type IN ('archived', 'transform')),
    p AS (SELECT g."table", count(*) AS n_pii, count(h.source) AS n_handled, count(h.source) = count(*) AS all_handled FROM glossary g
        LEFT JOIN h ON h."table" = g."table" AND h.source = g.name WHERE g.pii GROUP BY 1)"""


@R.add("pii_handling", _PII + " SELECT * FROM p")
def pii_handling(spark, sf_dir):
    return runs.pii_handling(literal(spark, "glossary"), literal(spark, "mappings"))


@R.add(
    "pii_regulation",
    f"""WITH {ctes("glossary")} SELECT name, CASE WHEN contains(lower(name), 'ssn') THEN 'HIPAA / PII' WHEN regexp_matches(lower(name), 'bank|card') THEN 'PCI-DSS'
        WHEN contains(lower(name), 'license') THEN 'PII' WHEN contains(lower(name), 'birth') THEN 'HIPAA' ELSE 'PII' END AS regulation FROM glossary WHERE pii""",
)
def pii_regulation(spark, sf_dir):
    return literal(spark, "glossary").where("pii").select("name", names.regulation(F.col("name")).alias("regulation"))


@R.add(
    "naming_modern",
    f"""WITH {ctes("mappings")} SELECT count(*) FILTER (regexp_matches(target, '^[a-z][a-z0-9_]*$')) AS n_pass, count(*) FILTER (NOT regexp_matches(target, '^[a-z][a-z0-9_]*$')) AS n_violations
    FROM mappings WHERE type NOT IN ('archived', 'removed') AND target IS NOT NULL""",
)
def naming_modern(spark, sf_dir):
    used = literal(spark, "mappings").where("type NOT IN ('archived', 'removed') AND target IS NOT NULL")
    fine = F.col("target").rlike(governance.NAMING)
    return used.agg(F.count_if(fine).alias("n_pass"), F.count_if(~fine).alias("n_violations"))


@R.add("gov_status_counts", f"WITH {ctes('governance_rows')} SELECT category, status, count(*) AS n FROM governance_rows GROUP BY 1, 2")
def gov_status_counts(spark, sf_dir):
    return runs.count_by(literal(spark, "governance_rows"), "category", "status")


@R.add("pii_violations", f"WITH {ctes('governance_rows')} SELECT item FROM governance_rows WHERE category = 'PII' AND status = 'VIOLATION'")
def pii_violations(spark, sf_dir):
    return literal(spark, "governance_rows").where("category = 'PII' AND status = 'VIOLATION'").select("item")


@R.add(
    "compliance_checklist",
    _PII
    + f""", {ctes("governance_rows", "runs", "ddl_new")}, v AS (SELECT count(*) AS n FROM mappings WHERE target IS NOT NULL AND NOT regexp_matches(target, '^[a-z][a-z0-9_]*$')),
    checks AS (SELECT 'pii_handled' AS "check", bool_and(all_handled) AS passed FROM p UNION ALL SELECT 'naming', n = 0 FROM v
    UNION ALL SELECT 'no_violations', count(*) FILTER (status = 'VIOLATION') = 0 FROM governance_rows
    UNION ALL SELECT 'pre_at_least_70', min(score) >= 70 FROM runs WHERE phase = 'pre' UNION ALL SELECT 'post_at_least_90', min(score) >= 90 FROM runs WHERE phase = 'post'
    UNION ALL SELECT 'schema_generated', count(*) > 0 FROM ddl_new)
    SELECT * FROM checks UNION ALL SELECT 'all_passed', bool_and(passed) FROM checks""",
)
def compliance_checklist(spark, sf_dir):
    bad = governance.naming_violations(literal(spark, "mappings").where("target IS NOT NULL").select(F.col("target").alias("column_name")))
    return runs.compliance_checklist(pii_handling(spark, sf_dir), bad, literal(spark, "governance_rows"), literal(spark, "runs"), literal(spark, "ddl_new"))


@R.add(
    "pii_detection",
    f"""WITH {ctes("glossary", "pii_tags")}, t AS (SELECT "table", name, string_agg(DISTINCT tag, ', ' ORDER BY tag) AS method FROM pii_tags GROUP BY 1, 2)
    SELECT g."table", g.name, coalesce(method, 'keyword match') AS method FROM glossary g LEFT JOIN t ON t."table" = g."table" AND t.name = g.name WHERE pii""",
)
def pii_detection(spark, sf_dir):
    return runs.detection_methods(literal(spark, "glossary"), literal(spark, "pii_tags"))


@R.add("sql_migration_rollup", f"WITH {ctes('sql_objects')} SELECT type, count(*) AS n, sum(changes)::BIGINT AS changes FROM sql_objects GROUP BY type")
def sql_migration_rollup(spark, sf_dir):
    return literal(spark, "sql_objects").groupBy("type").agg(F.count("*").alias("n"), F.sum("changes").alias("changes"))


_KINDS = {"hash": "SHA256", "case": r"\bCASE\b", "cast": r"\bCAST\(", "date": r"\bTO_DATE\b", "coalesce": r"\bCOALESCE\b", "trim": r"\bTRIM\("}


@R.add(
    "transform_count",
    f"WITH {ctes('sql_objects')} SELECT name, " + ", ".join(f"len(regexp_extract_all(script, '{p}'))::BIGINT AS n_{k}" for k, p in _KINDS.items()) + " FROM sql_objects",
)
def transform_count(spark, sf_dir):
    return literal(spark, "sql_objects").select("name", *(F.regexp_count("script", F.lit(p)).cast("long").alias(f"n_{k}") for k, p in _KINDS.items()))


@R.add(
    "rules_by_paragraph",
    f"WITH {ctes('rules')} SELECT program, paragraph, count(*) AS n, array_to_string(list_sort(list_distinct(list(rule_type))), ',') AS types FROM rules GROUP BY 1, 2",
)
def rules_by_paragraph(spark, sf_dir):
    types = F.array_join(F.array_sort(F.collect_set("rule_type")), ",")  # a handful of rule types
    return literal(spark, "rules").groupBy("program", "paragraph").agg(F.count("*").alias("n"), types.alias("types"))


@R.add(
    "field_io",
    f"""WITH {ctes("uses")}, m AS (SELECT program, field, bool_or(mode = 'r') AS r, bool_or(mode = 'w') AS w FROM uses GROUP BY 1, 2)
    SELECT program, field, CASE WHEN r AND w THEN 'working' WHEN r THEN 'input' ELSE 'output' END AS kind FROM m""",
)
def field_io(spark, sf_dir):
    return runs.field_io(literal(spark, "uses"))


@R.add("ddl_diff", f"WITH {ctes('ddl_old', 'ddl_new')} SELECT 'old' AS side, line FROM (SELECT line FROM ddl_old EXCEPT ALL SELECT line FROM ddl_new) UNION ALL SELECT 'new', line FROM (SELECT line FROM ddl_new EXCEPT ALL SELECT line FROM ddl_old)")
def ddl_diff(spark, sf_dir):
    old, new = literal(spark, "ddl_old"), literal(spark, "ddl_new")
    return old.exceptAll(new).select(F.lit("old").alias("side"), "line").union(new.exceptAll(old).select(F.lit("new"), "line"))


@R.add("signoffs", f"WITH {ctes('signoffs')}, s AS (SELECT string_split(line, '|') AS p FROM signoffs) SELECT p[1] AS signed_on, p[2] AS dataset, p[3] AS phase, p[4] AS who, p[5] = 'approved' AS approved FROM s")
def signoffs(spark, sf_dir):
    return runs.read_signoffs(literal(spark, "signoffs"))


@R.add(
    "signoff_gate",
    f"""WITH {ctes("signoffs", "runs")}, s AS (SELECT string_split(line, '|') AS p FROM signoffs)
    SELECT DISTINCT dataset, dataset IN (SELECT p[2] FROM s WHERE p[3] = 'pre' AND p[5] = 'approved') AS may_run_post FROM runs""",
)
def signoff_gate(spark, sf_dir):
    return runs.signoff_gate(literal(spark, "runs"), signoffs(spark, sf_dir))


@R.add(
    "pair_by_length",
    f"""WITH {ctes("data_files", "layouts")} SELECT file, layout, abs(line_length - record_length)::INTEGER AS gap FROM data_files JOIN layouts ON abs(line_length - record_length) <= 2
    QUALIFY row_number() OVER (PARTITION BY file ORDER BY gap, layout) = 1""",
)
def pair_by_length(spark, sf_dir):
    return matching.pair_by_length(literal(spark, "data_files"), literal(spark, "layouts"))


@R.add(
    "load_order",
    f"""WITH RECURSIVE {ctes("edges", "schema_tables")}, d AS (SELECT "table", 0 AS level FROM schema_tables UNION ALL SELECT child, level + 1 FROM d JOIN edges ON parent = "table")
    SELECT "table", max(level)::INTEGER AS level FROM d GROUP BY 1""",
)
def load_order(spark, sf_dir):
    return loading.load_order(literal(spark, "edges"), literal(spark, "schema_tables"))


@R.add("downstream_count", f"""WITH {ctes("lineage")} SELECT "table", count(DISTINCT downstream) AS n_downstream FROM lineage WHERE downstream <> '' GROUP BY 1""")
def downstream_count(spark, sf_dir):
    return monitor.downstream_count(literal(spark, "lineage"))


@R.add(
    "rationalize",
    f"""WITH {ctes("table_stats")}, s AS (SELECT "table", round((CASE WHEN query_count > 0 THEN least(100.0, 20 + 25 * log10(query_count)) ELSE 50.0 END) * 0.35::DOUBLE
        + (CASE WHEN n_downstream = 0 THEN 0 WHEN n_downstream <= 1 THEN 30 WHEN n_downstream <= 3 THEN 55 WHEN n_downstream <= 5 THEN 75 WHEN n_downstream <= 10 THEN 90 ELSE 100 END) * 0.25::DOUBLE
        + (CASE WHEN age_days IS NULL THEN 25 WHEN age_days <= 7 THEN 100 WHEN age_days <= 30 THEN 85 WHEN age_days <= 90 THEN 65 WHEN age_days <= 180 THEN 45 WHEN age_days <= 365 THEN 25 ELSE 10 END) * 0.2::DOUBLE
        + completeness * 0.1::DOUBLE + tier_score * 0.1::DOUBLE, 2) AS score FROM table_stats)
    SELECT "table", score, CASE WHEN score >= 70 THEN 'migrate' WHEN score >= 40 THEN 'review' ELSE 'archive' END AS recommendation FROM s""",
)
def rationalize(spark, sf_dir):
    return monitor.rationalize(literal(spark, "table_stats"))


@R.add("parse_cobol_desc", f"""WITH {ctes("glossary")}, a AS (SELECT name, regexp_replace(lower(name), '^[a-z]{{2,3}}_', '') AS short, regexp_replace(upper(trim(description)), '\\s*\\(.*?\\)\\s*$', '') AS d FROM glossary),
    b AS (SELECT *, lower(array_to_string(list_filter(string_split(d, '-')[2:], lambda p: p <> ''), '_')) AS modern FROM a)
    SELECT name, CASE WHEN d IS NULL OR (contains(d, ' ') AND NOT contains(d, '-')) OR modern = '' OR modern = 'filler' OR starts_with(short, 'fil') OR short = modern THEN NULL ELSE modern END AS modern FROM b""")
def parse_cobol_desc(spark, sf_dir):
    return literal(spark, "glossary").select("name", names.from_copybook_description(F.col("name"), F.col("description")).alias("modern"))


_VERBS = ", ".join(f"('{v}', '{k}')" for v, k in legacy_code.VERBS.items())


@R.add(
    "cobol_rules",
    f"""WITH {ctes("programs")}, verbs AS (SELECT * FROM (VALUES {_VERBS}) AS v(verb, rule_type)),
    l AS (SELECT program, generate_subscripts(string_split(source, chr(10)), 1) AS line, unnest(string_split(source, chr(10))) AS raw FROM programs),
    t AS (SELECT program, line, upper(rtrim(CASE WHEN length(raw) > 6 THEN substr(raw, 7, 66) ELSE raw END)) AS text FROM l WHERE substr(raw, 7, 1) <> '*'),
    p AS (SELECT *, regexp_extract(text, '^ ?([A-Z0-9][A-Z0-9-]*)\\.$', 1) AS h, regexp_extract(trim(text), '^([A-Z]+)\\b', 1) AS verb FROM t),
    q AS (SELECT *, last_value(nullif(h, '') IGNORE NULLS) OVER w AS paragraph, max(CASE WHEN contains(text, 'PROCEDURE DIVISION') THEN 1 ELSE 0 END) OVER w AS inside
        FROM p WINDOW w AS (PARTITION BY program ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
    SELECT program, line::INTEGER AS line, coalesce(paragraph, '') AS paragraph, verb, rule_type, CASE WHEN verb <> 'IF' THEN 'INFO'
        WHEN regexp_matches(text, '{legacy_code.HIGH}') THEN 'HIGH' WHEN regexp_matches(text, '{legacy_code.MEDIUM}') THEN 'MEDIUM' ELSE 'INFO' END AS severity
    FROM q JOIN verbs USING (verb) WHERE inside = 1""",
)
def cobol_rules(spark, sf_dir):
    return legacy_code.cobol_rules(literal(spark, "programs"))


_LINES = f"""WITH {ctes("programs")}, l AS (SELECT program, generate_subscripts(string_split(source, chr(10)), 1) AS line, unnest(string_split(source, chr(10))) AS raw FROM programs),
    t AS (SELECT program, line, upper(rtrim(CASE WHEN length(raw) > 6 THEN substr(raw, 7, 66) ELSE raw END)) AS text FROM l WHERE substr(raw, 7, 1) <> '*')"""


@R.add(
    "program_layouts",
    _LINES
    + """, i AS (SELECT program, line, text, regexp_extract(text, '^ *([0-9][0-9]) +([A-Z][A-Z0-9-]*)', 1) AS level, regexp_extract(text, '^ *([0-9][0-9]) +([A-Z][A-Z0-9-]*)', 2) AS name FROM t),
    h AS (SELECT *, last_value(CASE WHEN level = '01' THEN line END IGNORE NULLS) OVER (PARTITION BY program ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS head FROM i WHERE level <> '')
    SELECT f.program, r.name AS record, count(*) AS n_fields, string_agg(f.name, ',' ORDER BY f.line) AS fields FROM h f JOIN h r ON r.program = f.program AND r.line = f.head
    WHERE f.level <> '01' AND contains(f.text, ' PIC ') GROUP BY f.program, r.name, f.head HAVING count(*) >= 2""",
)
def program_layouts(spark, sf_dir):
    return legacy_code.program_layouts(literal(spark, "programs"))


_FIELD = "[A-Z][A-Z0-9-]*"


@R.add(
    "field_uses",
    _LINES
    + f""", s AS (SELECT program, min(line) AS start FROM t WHERE contains(text, 'PROCEDURE DIVISION') GROUP BY 1),
    b AS (SELECT program, regexp_replace(text, chr(39) || '[^' || chr(39) || ']*' || chr(39), '0', 'g') AS x FROM t JOIN s USING (program) WHERE line > start),
    u AS (SELECT program, unnest(regexp_extract_all(x, 'MOVE +({_FIELD}) +TO ', 1)) AS field, 'r' AS mode FROM b
    UNION ALL SELECT program, unnest(regexp_extract_all(x, '(MOVE|ADD) +[^ ]+ +TO +({_FIELD})', 2)), 'w' FROM b UNION ALL SELECT program, unnest(regexp_extract_all(x, 'ADD +({_FIELD}) +TO ', 1)), 'r' FROM b
    UNION ALL SELECT program, unnest(regexp_extract_all(x, 'COMPUTE +({_FIELD}) *=', 1)), 'w' FROM b UNION ALL SELECT program, unnest(regexp_extract_all(x, '[=*/+-] +({_FIELD})', 1)), 'r' FROM b
    UNION ALL SELECT program, unnest(regexp_extract_all(x, 'IF +({_FIELD})', 1)), 'r' FROM b)
    SELECT DISTINCT * FROM u""",
)
def field_uses(spark, sf_dir):
    return legacy_code.field_uses(literal(spark, "programs"))


@R.add(
    "sql_lineage",
    f"""WITH {ctes("scripts")}, c AS (SELECT name, lower(regexp_replace(regexp_replace(script, '--[^\\n]*', ' ', 'g'), '/[*].*?[*]/', ' ', 'gs')) AS s FROM scripts),
    w AS (SELECT name, unnest(regexp_extract_all(s, '(insert +into|update|merge +into|delete +from|truncate +table) +([a-z_][a-z0-9_.]*)', 2)) AS "table", 'write' AS use FROM c),
    r AS (SELECT name, unnest(regexp_extract_all(regexp_replace(s, 'delete +from', '', 'g'), '\\b(from|join) +([a-z_][a-z0-9_.]*)', 2)) AS "table", 'read' AS use FROM c)
    SELECT DISTINCT * FROM (SELECT * FROM w UNION ALL SELECT * FROM r)""",
)
def sql_lineage(spark, sf_dir):
    return legacy_code.sql_tables(literal(spark, "scripts"))


@R.add(
    "type_map",
    f"""WITH {ctes("type_names")} SELECT data_type, CASE data_type WHEN 'VARCHAR2(30)' THEN 'string' WHEN 'NUMBER(10, 2)' THEN 'decimal(10,2)' WHEN 'number' THEN 'decimal' WHEN 'Integer' THEN 'int'
        WHEN 'TIMESTAMP WITH TIME ZONE' THEN 'timestamp' WHEN 'double precision' THEN 'double' WHEN 'BLOB' THEN 'binary' WHEN 'bool' THEN 'boolean' ELSE 'string' END AS spark_type FROM type_names""",
)
def type_map(spark, sf_dir):
    return literal(spark, "type_names").select("data_type", types.spark_type(F.col("data_type")).alias("spark_type"))


@R.add(
    "dialect_functions",
    """WITH c AS (SELECT c_custkey, c_name, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_mktsegment END AS s FROM customer)
    SELECT c_custkey, coalesce(s, 'none') AS nvl, CASE WHEN s IS NOT NULL THEN 'yes' ELSE 'no' END AS nvl2,
        CASE s WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN 2 ELSE 0 END AS decode, instr(c_name, '#')::INTEGER AS instr, substr(c_name, 2, 5) AS substr, length(c_name)::INTEGER AS length,
        c_name || '-' || coalesce(s, '') AS concat, strftime(DATE '2024-01-31' + INTERVAL 1 MONTH, '%Y%m%d') AS dateadd, date_diff('day', DATE '2024-01-01', DATE '2024-03-01')::INTEGER AS datediff FROM c""",
)
def dialect_functions(spark, sf_dir):
    """The functions that legacy dialects name differently, by their Spark built-ins."""
    s = F.when(F.col("c_custkey") % 4 != 0, F.col("c_mktsegment"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", s.alias("s"))
    return rows.selectExpr(
        "c_custkey", "nvl(s, 'none') AS nvl", "nvl2(s, 'yes', 'no') AS nvl2", "decode(s, 'BUILDING', 1, 'MACHINERY', 2, 0) AS decode", "instr(c_name, '#') AS instr",
        "substr(c_name, 2, 5) AS substr", "length(c_name) AS length", "concat(c_name, '-', nvl(s, '')) AS concat",
        "date_format(add_months(date'2024-01-31', 1), 'yyyyMMdd') AS dateadd", "datediff(date'2024-03-01', date'2024-01-01') AS datediff",
    )
