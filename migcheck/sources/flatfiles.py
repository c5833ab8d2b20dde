"""Fixed-width, record and delimited files as lazy DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from migcheck.functions.mainframe import decode_ebcdic, decode_packed
from migcheck.sources import records
from migcheck.sources.copybook import Field, record_length

PACKED = ("COMP-3", "PACKED-DECIMAL")


def data_fields(fields: list[Field]) -> list[Field]:
    return [f for f in fields if not f.is_filler]


def read_fixed_width(spark: SparkSession, path: str, fields: list[Field], keep_damaged: bool = False) -> DataFrame:
    """One row a line, every field cut out by its offset and trimmed; blank lines are skipped.

    With ``keep_damaged`` lines shorter than the layout also come whole in ``_damaged``.
    """
    lines = spark.read.text(path).where(F.trim("value") != "")
    columns = [F.trim(F.substring("value", f.offset + 1, f.length)).alias(f.column) for f in data_fields(fields)]
    if keep_damaged:
        columns.append(F.when(F.length("value") < record_length(fields), F.col("value")).alias("_damaged"))
    return lines.select(columns)


def read_records(spark: SparkSession, path: str, fields: list[Field], encoding: str = "ascii") -> DataFrame:
    """Records of a fixed number of bytes without line ends, in ASCII or EBCDIC, packed decimals decoded."""
    rows = records.read_records(spark, path, record_length(fields))

    def cell(f: Field) -> Column:
        raw = F.substring("record", f.offset + 1, f.length)
        if f.usage in PACKED:
            return decode_packed(raw, f.decimals)
        return F.trim(decode_ebcdic(raw) if encoding.lower() in ("ebcdic", "cp037") else F.decode(raw, "ISO-8859-1"))

    return rows.select(*(cell(f).alias(f.column) for f in data_fields(fields)))


def sniff_delimiter(spark: SparkSession, path: str) -> str | None:
    """The first of pipe, tab and semicolon that stands three times or more in the first line, else None."""
    first = spark.read.text(path).limit(1).collect()
    return next((d for d in "|\t;" if first and first[0]["value"].count(d) >= 3), None)


def clean_columns(df: DataFrame) -> DataFrame:
    """Trimmed lower-case column names with underscores, and trimmed texts; nulls stay null."""
    names = [c.strip().lower().replace("-", "_") for c in df.columns]
    df = df.toDF(*names)
    return df.select(*(F.trim(f"`{n}`").alias(n) if isinstance(df.schema[n].dataType, T.StringType) else F.col(f"`{n}`") for n in names))


def read_delimited(spark: SparkSession, path: str, delimiter: str | None = None) -> DataFrame:
    """A delimited file with a header; without a delimiter it is sniffed, a comma failing that."""
    sep = delimiter or sniff_delimiter(spark, path) or ","
    return clean_columns(spark.read.csv(path, sep=sep, header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True))


def drop_filler(df: DataFrame) -> DataFrame:
    return df.drop(*(c for c in df.columns if "filler" in c.lower()))


def preview(df: DataFrame, rows: int = 25) -> DataFrame:
    """The first rows with delimiters taken out of the texts."""
    cells = [F.translate(c, "|,\t;", "").alias(c) if isinstance(f.dataType, T.StringType) else F.col(c) for c, f in zip(df.columns, df.schema.fields)]
    return df.select(cells).limit(rows)
