"""What the queries share: a registry, the driver tables, and small literal tables for both engines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Queries by key, with the SQL that must give the same rows."""

    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def add(self, key: str, sql: str | None = None) -> Callable[[Query], Query]:
        def put(query: Query) -> Query:
            self.queries[key] = query
            if sql:
                self.oracles[key] = sql
            return query

        return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Literal metadata: name -> (columns with SQL types, rows)
LITERALS: dict[str, tuple[str, list[tuple]]] = {
    "mappings": (
        "table string, source string, target string, type string, confidence double",
        [
            ("orders", "o_orderkey", "order_id", "rename", 1.0),
            ("orders", "o_custkey", "customer_id", "rename", 0.95),
            ("orders", "o_orderstatus", "order_status", "rename", 0.95),
            ("orders", "o_totalprice", "total_price", "rename", 0.9),
            ("orders", "o_orderdate", "ordered_at", "transform", 0.9),
            ("orders", "o_orderpriority", None, "removed", 0.8),
            ("customer", "c_custkey", "customer_id", "rename", 1.0),
            ("customer", "c_name", "customer_name", "transform", 0.9),
            ("customer", "c_acctbal", "balance", "archived", 0.85),
            (None, "c_nationkey", "nation_id", "rename", 0.7),
            (None, "c_mktsegment", None, "pending", 0.0),
        ],
    ),
    "glossary": (
        "table string, name string, pii boolean, description string",
        [
            ("orders", "o_orderkey", False, "ORDER-KEY"),
            ("orders", "o_custkey", False, "ORDER-CUSTOMER"),
            ("customer", "c_name", True, "CUSTOMER-FULL-NAME"),
            ("customer", "c_acctbal", True, "CUSTOMER-BANK-BALANCE"),
            ("customer", "c_phone", True, "CUSTOMER-PHONE (PIC X)"),
            ("supplier", "s_ssn", True, "free text here"),
            ("supplier", "s_birth_date", True, None),
            ("supplier", "s_license", True, "SUPPLIER"),
            ("supplier", "s_card_no", True, "SUPPLIER-CARD-NO"),
        ],
    ),
    "results": (
        "dataset string, phase string, validator string, status string, penalty double",
        [
            ("orders", "pre", "schema_diff", "WARN", 6.0),
            ("orders", "pre", "profile_risk", "PASS", 0.0),
            ("orders", "post", "row_count", "FAIL", 1.03),
            ("orders", "post", "sample_compare", "WARN", 0.75),
            ("customer", "pre", "schema_diff", "FAIL", 41.5),
            ("customer", "post", "row_count", "PASS", 0.0),
            ("customer", "post", "referential_integrity", "FAIL", 70.0),
            ("customer", "post", "archived_leakage", "FAIL", 40.0),
        ],
    ),
    "runs": (
        "run_id string, run_date string, dataset string, phase string, score double",
        [
            ("run_01", "2026-02-14", "orders", "pre", 80.0),
            ("run_02", "2026-02-14", "orders", "post", 62.5),
            ("run_03", "2026-02-20", "customer", "pre", 71.0),
            ("run_04", "2026-02-21", "orders", "pre", 94.0),
            ("run_05", "2026-02-21", "orders", "post", 96.5),
            ("run_06", "2026-02-25", "customer", "post", 0.0),
            ("run_07", "2026-02-25", "supplier", "pre", 88.25),
            ("run_08", "2026-02-25", "orders", "post", 97.25),
        ],
    ),
    "components": (
        "dataset string, structure double, integrity double, governance double",
        [("orders", 94.0, 98.0, 85.0), ("customer", 58.5, 30.0, 75.0), ("supplier", 100.0, 100.0, 100.0)],
    ),
    "governance_rows": (
        "category string, item string, status string",
        [
            ("PII", "c_name", "PASS"), ("PII", "c_acctbal", "VIOLATION"), ("PII", "s_ssn", "VIOLATION"),
            ("NAMING", "o_orderkey", "PASS"), ("NAMING", "Bad-Name", "WARN"), ("NULLS", "props", "PASS"),
        ],
    ),
    "names": (
        "table string, source string, data_type string",
        [
            ("claimants", "cl_recid", "integer"), ("claimants", "cl_fnam", "char"), ("claimants", "cl_lnam", "char"), ("claimants", "cl_ssn", "char"),
            ("claimants", "cl_dob", "char"), ("claimants", "cl_phon", "char"), ("claimants", "cl_emal", "varchar"), ("claimants", "cl_st", "char"),
            ("claimants", "cl_zip", "char"), ("claimants", "cl_bact", "char"), ("claimants", "cl_stat", "char"), ("claimants", "cl_rgdt", "char"),
            ("claimants", "cl_dcsd", "char"), ("claimants", "cl_fil1", "char"), ("claims", "cm_recid", "integer"), ("claims", "cm_clmnt", "integer"),
            ("claims", "cm_wkamt", "decimal"), ("claims", "cm_stat", "char"), ("payments", "bp_payam", "decimal"), ("payments", "CreatedAt", "timestamp"),
            ("payments", "bp_EventCode", "char"), ("payments", "email_address", "varchar"), ("payments", "bad name!", "char"),
        ],
    ),
    "modern_names": (
        "table string, target string",
        [
            ("claimants", "claimant_id"), ("claimants", "first_name"), ("claimants", "last_name"), ("claimants", "ssn_hash"), ("claimants", "date_of_birth"),
            ("claimants", "phone_number"), ("claimants", "email"), ("claimants", "state"), ("claimants", "zip_code"), ("claimants", "claimant_status"),
            ("claimants", "registered_at"), ("claimants", "is_deceased"), ("claims", "claim_id"), ("claims", "claimant_id"), ("claims", "weekly_benefit_amount"),
            ("claims", "claim_status"), ("payments", "payment_amount"), ("payments", "created_at"),
        ],
    ),
    "table_stats": (
        "table string, query_count bigint, n_downstream bigint, age_days bigint, completeness double, tier_score double",
        [
            ("orders", 1000, 12, 2, 98.5, 100.0), ("customer", 100, 4, 20, 91.25, 75.0), ("lineitem", 10, 2, 80, 100.0, 50.0),
            ("supplier", 1, 1, 150, 70.0, 25.0), ("part", 0, 0, 300, 40.0, 0.0), ("events", 0, 7, None, 66.6, 50.0), ("old", 0, 0, 400, 10.0, 0.0),
        ],
    ),
    "lineage": (
        "table string, column_name string, downstream string",
        [
            ("orders", "o_orderkey", "lineitem"), ("orders", "o_orderkey", "revenue"), ("orders", "o_custkey", "revenue"), ("customer", "c_custkey", "orders"),
            ("customer", "c_name", ""), ("part", "p_partkey", "lineitem"), ("supplier", "s_suppkey", ""),
        ],
    ),
    "edges": (
        "child string, parent string",
        [("nation", "region"), ("customer", "nation"), ("supplier", "nation"), ("orders", "customer"), ("lineitem", "orders"), ("lineitem", "part"), ("lineitem", "supplier")],
    ),
    "schema_tables": ("table string", [(t,) for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")]),
    "uses": (
        "program string, field string, mode string",
        [
            ("P1", "A", "r"), ("P1", "A", "w"), ("P1", "B", "r"), ("P1", "C", "w"), ("P1", "C", "w"), ("P2", "A", "r"), ("P2", "D", "w"), ("P2", "B", "w"), ("P2", "B", "r"),
        ],
    ),
    "rules": (
        "program string, paragraph string, rule_type string",
        [
            ("P1", "INIT", "MOVE"), ("P1", "INIT", "PERFORM"), ("P1", "CALC", "COMPUTE"), ("P1", "CALC", "IF"), ("P1", "CALC", "IF"), ("P2", "MAIN", "CALL"), ("P2", "MAIN", "EVALUATE"),
        ],
    ),
    "sql_objects": (
        "name string, type string, changes bigint, script string",
        [
            ("v_orders", "view", 3, "SELECT CAST(a AS INT), COALESCE(b, 0) FROM t"),
            ("p_load", "procedure", 7, "INSERT INTO x SELECT SHA256(ssn), CASE WHEN d = 'Y' THEN TRUE ELSE FALSE END, TRIM(n), TO_DATE(dt) FROM y"),
            ("p_audit", "procedure", 0, "SELECT 1"),
            ("v_cust", "view", 2, "SELECT TRIM(c), TRIM(d), CAST(e AS DATE) FROM c"),
        ],
    ),
    "ddl_old": ("line string", [("CREATE TABLE t (",), ("  id INTEGER,",), ("  name VARCHAR(20),",), ("  at TIMESTAMP",), (")",)]),
    "ddl_new": ("line string", [("CREATE TABLE t (",), ("  id NUMBER(10),",), ("  name VARCHAR2(20),",), ("  at TIMESTAMP",), (")",)]),
    "data_files": ("file string, line_length int", [("contacts.dat", 813), ("claims.dat", 121), ("tiny.dat", 9), ("odd.dat", 300)]),
    "layouts": ("layout string, record_length int", [("CONTACTS.cpy", 813), ("CLAIMS.cpy", 120), ("CLAIMS2.cpy", 123), ("TINY.cpy", 11), ("OTHER.cpy", 400)]),
    "programs": (
        "program string, source string",
        [
            (
                "CLMUPD",
                "000100 IDENTIFICATION DIVISION.\n000200 PROCEDURE DIVISION.\n000300 MAIN-PARA.\n000400*    IF COMMENTED\n000500     IF CLAIM-AMT NOT NUMERIC\n"
                "000600        MOVE 'E' TO STATUS-CD\n000700     PERFORM CHECK-PARA.\n000800 CHECK-PARA.\n000900     IF STATUS-CD = 'INVALID'\n001000     COMPUTE TOTAL = A + B.\n001100     STOP RUN.",
            ),
            ("PAYRUN", "       PROCEDURE DIVISION.\n           CALL 'SUB' USING X.\n       A-1.\n           EVALUATE KIND\n           ADD 1 TO N.\n           IF N > 3"),
            ("EMPTY", ""),
            (
                "LAYOUT",
                "       DATA DIVISION.\n       01  CLAIM-REC.\n           05  CLAIM-ID    PIC 9(8).\n           05  CLAIM-DATES.\n               10  FROM-DT PIC X(8).\n               10  TO-DT   PIC X(8).\n"
                "       01  FLAG-REC.\n           05  FLAG        PIC X.\n       01  PAY-REC.\n           05  AMT         PIC S9(7)V99 COMP-3.\n           05  FILLER      PIC X(3).\n"
                "       PROCEDURE DIVISION.\n       MAIN.\n           MOVE CLAIM-ID TO PAY-ID.\n           MOVE 'X' TO FLAG.\n           COMPUTE AMT = RATE * WEEKS.\n           IF AMT > LIMIT\n           ADD AMT TO TOTAL.",
            ),
        ],
    ),
    "scripts": (
        "name string, script string",
        [
            ("p1", "INSERT INTO mart.claims SELECT * FROM legacy.claims c JOIN legacy.claimants k ON c.id = k.id -- FROM nowhere"),
            ("p2", "/* from old */ UPDATE claims SET x = 1; DELETE FROM audit_log"),
            ("p3", "SELECT 1"),
        ],
    ),
    "type_names": (
        "data_type string",
        [("VARCHAR2(30)",), ("NUMBER(10, 2)",), ("number",), ("Integer",), ("TIMESTAMP WITH TIME ZONE",), ("double precision",), ("BLOB",), ("xml",), ("CHAR(1)",), ("bool",)],
    ),
    "pii_tags": ("table string, name string, tag string", [("supplier", "s_ssn", "PII.Sensitive"), ("supplier", "s_ssn", "PII.NationalId"), ("customer", "c_phone", "PII.Contact")]),
    "terms": (
        "source string, term string, modern string",
        [("cl_fnam", "Claimant First Name", None), ("cl_dob", "Birth Date", None), ("cl_stat", "Status", None), ("cm_recid", "Claim Key Id", "claim_id"), ("bp_EventCode", "Payment Event-Code (old)", "")],
    ),
    "transform_scripts": (
        "table string, script string",
        [("orders", "SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderdate AS ordered_at, old_price FROM legacy"), ("customer", "  "), ("supplier", "SELECT sha256(s_name), CASE WHEN f = 'Y' THEN 1 END FROM legacy")],
    ),
    "transform_mappings": (
        "table string, source string, target string, type string, rationale string",
        [
            ("orders", "o_orderkey", "order_id", "rename", None), ("orders", "o_orderdate", "ordered_at", "transform", "date"), ("orders", "o_clerk", "clerk_hash", "transform", "SHA-256 hash"),
            ("orders", "o_price", "old_price", "archived", None), ("orders", "o_note", None, "removed", None), ("customer", "c_name", "name", "transform", None),
            ("supplier", "s_name", "name_hash", "transform", "hashed"), ("part", "p_name", "name", "transform", "hash"),
        ],
    ),
    "signoffs": (
        "line string",
        [("2026-02-14|orders|pre|alice|approved",), ("2026-02-20|customer|pre|bob|rejected",), ("2026-02-21|orders|post|carol|approved",)],
    ),
}


def literal(spark: SparkSession, name: str) -> DataFrame:
    columns, rows = LITERALS[name]
    return spark.createDataFrame(rows, columns).coalesce(1)


def sql_value(value, kind: str) -> str:
    if value is None:
        return f"CAST(NULL AS {kind})"
    if isinstance(value, bool):
        return str(value).upper()
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else f"CAST({value} AS {kind})"


def ctes(*names: str) -> str:
    """``name AS (...)`` for each literal table, comma-joined."""
    kinds = {"string": "VARCHAR", "double": "DOUBLE", "bigint": "BIGINT", "int": "INTEGER", "boolean": "BOOLEAN"}
    out = []
    for name in names:
        columns, rows = LITERALS[name]
        fields = [f.strip().split(" ") for f in columns.split(",")]
        values = ", ".join("(" + ", ".join(sql_value(v, kinds[k]) for v, (_, k) in zip(row, fields)) + ")" for row in rows)
        quoted = ", ".join(f'"{n}"' for n, _ in fields)
        out.append(f"{name} AS (SELECT * FROM (VALUES {values}) AS v({quoted}))")
    return ",\n".join(out)


def modern_orders(orders: DataFrame) -> DataFrame:
    """The modern side of orders, with losses and changes at fixed keys."""
    key = F.col("o_orderkey")
    return orders.where(key % 97 != 0).select(
        key.alias("order_id"),
        F.col("o_custkey").alias("customer_id"),
        F.when(key % 50 == 0, F.lower("o_orderstatus")).otherwise(F.col("o_orderstatus")).alias("order_status"),
        F.when(key % 40 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")).alias("total_price"),
        F.col("o_orderdate").alias("ordered_at"),
    )


def modern_customer(customer: DataFrame) -> DataFrame:
    return customer.where(F.col("c_custkey") % 31 != 0).select(
        F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("customer_name"), F.col("c_acctbal").alias("balance")
    )


MODERN = """
m_orders AS (SELECT o_orderkey AS order_id, o_custkey AS customer_id,
    CASE WHEN o_orderkey % 50 = 0 THEN lower(o_orderstatus) ELSE o_orderstatus END AS order_status,
    CASE WHEN o_orderkey % 40 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS total_price,
    o_orderdate AS ordered_at FROM orders WHERE o_orderkey % 97 <> 0),
m_customer AS (SELECT c_custkey AS customer_id, c_name AS customer_name, c_acctbal AS balance FROM customer WHERE c_custkey % 31 <> 0)
"""
