"""Flat-file sources over small files written on the spot into the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from migcheck.functions import mainframe
from migcheck.queries.common import Registry, table
from migcheck.sources import copybook, flatfiles
from migcheck.sources.shared import shared_dir

R = Registry()

LAYOUT = """
      * customer extract
       01  CUSTOMER-REC.
           05  CUST-KEY        PIC 9(8).
           05  CUST-NAME       PIC X(20).
           05  FILLER          PIC X(2).
           05  CUST-SEGMENT    PIC X(12).
"""
_ROWS = "SELECT lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS cust_key, c_name AS cust_name, c_mktsegment AS cust_segment FROM customer"


def _line(encode: bool = False):
    return F.concat(
        F.lpad(F.col("c_custkey").cast("string"), 8, "0"), F.rpad("c_name", 20, " "), F.lit("--"), F.rpad("c_mktsegment", 12, " ")
    )


@R.add("scan_fixed_width", _ROWS)
def scan_fixed_width(spark, sf_dir):
    path = shared_dir(spark, "fixed-width")
    table(spark, sf_dir, "customer").select(_line().alias("value")).write.text(path)
    return flatfiles.read_fixed_width(spark, path, copybook.parse(LAYOUT))


@R.add("scan_binary_records", _ROWS)
def scan_binary_records(spark, sf_dir):
    path = shared_dir(spark, "records")
    table(spark, sf_dir, "customer").select(_line().alias("value")).write.option("lineSep", " " * 8).text(path)  # 50 bytes a record
    fields = copybook.parse(LAYOUT + "           05  FILLER          PIC X(8).\n")
    return flatfiles.read_records(spark, path, fields)


@R.add("scan_delimited", "SELECT CAST(c_custkey AS VARCHAR) AS cust_key, c_name AS cust_name, c_mktsegment AS cust_segment FROM customer")
def scan_delimited(spark, sf_dir):
    path = shared_dir(spark, "delimited")
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias(" CUST-KEY "), F.col("c_name").alias("Cust-Name"), F.col("c_mktsegment").alias("cust_segment"), F.lit("x").alias("more"))
    rows.write.option("header", True).option("sep", "|").csv(path)
    return flatfiles.read_delimited(spark, path).drop("more")


@R.add("decode_ebcdic", "SELECT c_custkey, c_name AS text FROM customer")
def decode_ebcdic(spark, sf_dir):
    ascii_chars = "".join(chr(c) for c in range(32, 127))
    codes = ascii_chars.encode("cp037").decode("latin-1")
    raw = F.encode(F.translate("c_name", ascii_chars, codes), "ISO-8859-1")
    return table(spark, sf_dir, "customer").select("c_custkey", mainframe.decode_ebcdic(raw).alias("text"))


@R.add("decode_comp3", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN '-' ELSE '' END || c_custkey // 100 || '.' || lpad(CAST(c_custkey % 100 AS VARCHAR), 2, '0') AS amount FROM customer")
def decode_comp3(spark, sf_dir):
    sign = F.when(F.col("c_custkey") % 2 == 0, "D").otherwise("C")
    packed = F.unhex(F.concat(F.lpad(F.col("c_custkey").cast("string"), 9, "0"), sign))
    return table(spark, sf_dir, "customer").select("c_custkey", mainframe.decode_packed(packed, 2).alias("amount"))


@R.add(
    "copybook_schema",
    f"""WITH l AS (SELECT generate_subscripts(string_split('{LAYOUT}', chr(10)), 1) AS line_no, unnest(string_split('{LAYOUT}', chr(10))) AS line),
    p AS (SELECT line_no, regexp_extract(line, '^ +05 +([A-Z-]+) +PIC', 1) AS field, regexp_extract(line, 'PIC ([X9])', 1) AS kind, TRY_CAST(regexp_extract(line, 'PIC [X9][(]([0-9]+)[)]', 1) AS INTEGER) AS length FROM l)
    SELECT field, coalesce(sum(length) OVER (ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INTEGER AS "offset", length,
        CASE WHEN kind = 'X' THEN 'VARCHAR(' || length || ')' WHEN length <= 9 THEN 'INTEGER' ELSE 'BIGINT' END AS sql_type FROM p WHERE length IS NOT NULL""",
)
def copybook_schema(spark, sf_dir):
    rows = [(f.name, f.offset, f.length, f.sql_type) for f in copybook.parse(LAYOUT)]
    return spark.createDataFrame(rows, "field string, offset int, length int, sql_type string")


@R.add("drop_filler", "SELECT c_custkey, c_name FROM customer")
def drop_filler(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.col("c_nationkey").alias("FILLER_1"), F.col("c_mktsegment").alias("my_filler"))
    return flatfiles.drop_filler(df)


@R.add("preview_clean", """SELECT c_custkey, replace(c_name, '#', '') AS name FROM customer ORDER BY c_custkey LIMIT 25""")
def preview_clean(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").orderBy("c_custkey").select("c_custkey", F.regexp_replace("c_name", "#", "|").alias("name"))
    return flatfiles.preview(rows)
