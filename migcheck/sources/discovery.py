"""What a folder of extracts holds: files by kind, layouts for data files, catalog exports, alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from migcheck.functions.mainframe import decode_ebcdic
from migcheck.sources.copybook import Field
from migcheck.sources.flatfiles import data_fields

# Endings of file names by kind.
KINDS = {
    "copybook": "cpy cob copybook".split(),
    "datafile": "dat bin raw ebcdic".split(),
    "csv": "csv tsv".split(),
    "sql": "sql prc sp vw trg".split(),
    "program": "cbl cobol".split(),
}

# Words of record and file names that say what they are, not what they are about.
RECORD_WORDS = ("record", "rec", "data", "file", "area", "work", "master", "mstr", "detail", "header", "hdr", "ws", "wk", "fd")

# Short names of what a record is about -> words.
SUBJECTS = {"cust": "customer", "acct": "account", "tran": "transaction", "trans": "transaction", "card": "card", "xref": "cross_reference", "usr": "user", "grp": "group"}


def scan_folder(spark: SparkSession, path: str) -> DataFrame:
    """path, kind, stem, length of the files below a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    name = F.element_at(F.split("path", "/"), -1)
    ending = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    kind = F.lit(None).cast("string")
    for label, endings in KINDS.items():
        kind = F.when(ending.isin(*endings), label).otherwise(kind)
    in_data = F.lower("path").rlike("/data/[^/]*$")
    kind = F.coalesce(kind, F.when((ending == "txt") & in_data, "datafile"))
    stem = F.upper(F.regexp_replace(name, r"\.[^.]*$", ""))
    return files.where(~name.startswith(".")).select("path", kind.alias("kind"), stem.alias("stem"), "length").where("kind IS NOT NULL")


def pair_by_stem(files: DataFrame) -> DataFrame:
    """(stem, layout, data): copybooks and data files of one name."""
    side = lambda kind, name: files.where(F.col("kind") == kind).select("stem", F.col("path").alias(name))
    return side("copybook", "layout").join(side("datafile", "data"), "stem")


def is_ebcdic(raw: Column) -> Column:
    """Whether one of the first ten bytes is beyond ASCII."""
    return F.hex(F.substring(raw, 1, 10)).rlike("^(..)*[89A-F].")


def layout_fit(first_record: DataFrame, fields: list[Field]) -> DataFrame:
    """Percentage of a layout's fields whose slice of ``record`` is filled, printable and, for numbers, mostly digits."""
    text = F.when(is_ebcdic(F.col("record")), decode_ebcdic(F.col("record"))).otherwise(F.decode("record", "ISO-8859-1"))

    def fits(f: Field) -> Column:
        cell = F.trim(F.substring(text, f.offset + 1, f.length))
        printable = (cell != "") & ~cell.rlike(r"[^\x20-\x7E]")
        if "9" not in f.pic:
            return printable
        return printable & (F.length(F.regexp_replace(cell, "[^0-9]", "")) * 2 >= F.length(cell))

    own = data_fields(fields)
    total = sum((fits(f).cast("int") for f in own[1:]), fits(own[0]).cast("int"))
    return first_record.select(F.round(total * 100 / len(own), 2).alias("fit"))


def table_name(name: Column) -> Column:
    """A plural table name from a record or file name such as CUST-REC or ACCTDATA.

    Record words are dropped wherever they stand between separators, and one that is joined to the
    end; short words are written out; the last word takes an s.
    """
    subjects = F.create_map(*(F.lit(x) for pair in SUBJECTS.items() for x in pair))
    low = F.lower(F.translate(name, "-", "_"))
    kept = F.filter(F.split(low, "_"), lambda w: (w != "") & ~w.isin(*RECORD_WORDS, *(f"{w}s" for w in RECORD_WORDS)))
    bare = F.transform(kept, lambda w: F.regexp_replace(w, "(?<=..)(data|record|master)$", ""))
    base = F.array_join(F.transform(bare, lambda w: F.coalesce(F.try_element_at(subjects, w), w)), "_")
    return F.when(base == "", low).when(base.endswith("s"), base).otherwise(F.concat(base, F.lit("s")))


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """table, column_name, data_type, description, tags, position from a catalog's JSON export (one table a line)."""
    column = "struct<name:string,dataType:string,description:string,tags:array<struct<tagFQN:string>>,ordinalPosition:int>"
    tables = spark.read.schema(f"name string, columns array<{column}>").json(path)
    return tables.select(F.col("name").alias("table"), F.explode("columns").alias("c")).select(
        "table",
        F.lower("c.name").alias("column_name"),
        F.lower("c.dataType").alias("data_type"),
        "c.description",
        F.transform("c.tags", lambda t: t["tagFQN"]).alias("tags"),
        F.col("c.ordinalPosition").alias("position"),
    )


#: A catalog's export of an entity a line, as far as it is read: tables with profiles and lineage, and glossary terms.
EXPORT = """name string, profile struct<rowCount:bigint, columnCount:bigint>,
    columns array<struct<name:string, profile:struct<valuesCount:double, nullProportion:double, uniqueCount:double, distinctCount:double, min:string, max:string,
        mean:double, stddev:double, minLength:double, maxLength:double, histogram:struct<boundaries:array<string>, frequencies:array<bigint>>>>>,
    lineage struct<edges:array<struct<fromEntity:string, toEntity:string, columns:array<struct<fromColumns:array<string>, toColumn:string>>>>>"""


def read_catalog_profile(spark: SparkSession, path: str) -> DataFrame:
    """table, column_name, row_count, null_percent, distinct_count, min, max, mean, stddev, min_length, max_length, histogram of every profiled column."""
    tables = spark.read.schema(EXPORT).json(path)
    p = F.col("c.profile")
    return tables.select("name", "profile.rowCount", F.explode("columns").alias("c")).where(p.isNotNull()).select(
        F.col("name").alias("table"),
        F.lower("c.name").alias("column_name"),
        F.coalesce("rowCount", p["valuesCount"].cast("long")).alias("row_count"),
        F.round(p["nullProportion"] * 100, 2).alias("null_percent"),
        F.coalesce(p["distinctCount"], p["uniqueCount"]).cast("long").alias("distinct_count"),
        p["min"].alias("min_value"), p["max"].alias("max_value"), p["mean"].alias("mean"), p["stddev"].alias("stddev"),
        p["minLength"].cast("long").alias("min_length"), p["maxLength"].cast("long").alias("max_length"),
        F.arrays_zip(p["histogram"]["boundaries"].alias("boundary"), p["histogram"]["frequencies"].alias("n")).alias("histogram"),
    )


def read_catalog_lineage(spark: SparkSession, path: str) -> DataFrame:
    """table, column_name, downstream, downstream_column: an edge a row; edges of whole tables have null columns."""
    edges = spark.read.schema(EXPORT).json(path).select(F.explode("lineage.edges").alias("e"))
    columns = edges.select("e.fromEntity", "e.toEntity", F.explode_outer("e.columns").alias("c"))
    pairs = columns.select("fromEntity", "toEntity", F.explode_outer("c.fromColumns").alias("source"), F.col("c.toColumn").alias("target"))
    last = lambda name: F.lower(F.substring_index(name, ".", -1))
    return pairs.select(last("fromEntity").alias("table"), last("source").alias("column_name"), last("toEntity").alias("downstream"), last("target").alias("downstream_column")).distinct()


def read_catalog_glossary(spark: SparkSession, path: str) -> DataFrame:
    """term, display_name, description, synonyms, related of a catalog's glossary export (a term a line)."""
    terms = spark.read.schema("name string, displayName string, description string, synonyms array<string>, relatedTerms array<struct<name:string>>").json(path)
    return terms.where("name IS NOT NULL").select(
        F.lower("name").alias("term"), F.coalesce("displayName", "name").alias("display_name"), "description",
        F.coalesce("synonyms", F.array().cast("array<string>")).alias("synonyms"), F.transform(F.coalesce("relatedTerms", F.array()), lambda t: t["name"]).alias("related"),
    )


def append_alerts(alerts: DataFrame, path: str, mode: str = "append") -> None:
    """Write alerts as JSON lines, each with the time of writing."""
    alerts.withColumn("written_at", F.current_timestamp()).write.mode(mode).json(path)
