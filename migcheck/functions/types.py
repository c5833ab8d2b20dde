"""SQL type names of legacy systems as Spark types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spark type -> names that legacy systems give it.
NAMES = {
    "smallint": ["smallint", "tinyint"],
    "int": ["integer", "int", "serial"],
    "bigint": ["bigint", "bigserial"],
    "decimal": ["numeric", "decimal", "number"],
    "float": ["real", "binary_float"],
    "double": ["double precision", "double", "float", "binary_double"],
    "string": [
        "character varying", "varchar", "varchar2", "nvarchar", "nvarchar2", "character", "char", "nchar", "text", "clob", "nclob", "long", "string",
        "time", "time with time zone", "interval", "uuid", "json", "jsonb", "rowid",
    ],
    "boolean": ["boolean", "bool"],
    "date": ["date"],
    "timestamp_ntz": ["timestamp without time zone"],
    "timestamp": ["timestamp with time zone", "timestamp", "timestamptz"],
    "binary": ["bytea", "blob", "raw", "long raw"],
}
BY_NAME = {name: kind for kind, names in NAMES.items() for name in names}


def spark_type(name: Column) -> Column:
    """The Spark type of a SQL type name, keeping the digits of a decimal; unknown names are strings."""
    low = F.lower(F.trim(name))
    base = F.trim(F.regexp_replace(low, r"\(.*\)", ""))
    known = F.create_map(*(F.lit(x) for pair in BY_NAME.items() for x in pair))
    kind = F.coalesce(F.try_element_at(known, base), F.lit("string"))
    digits = F.regexp_extract(low, r"\(\s*(\d+\s*(?:,\s*\d+\s*)?)\)", 1)
    return F.when((kind == "decimal") & (digits != ""), F.concat(F.lit("decimal("), F.regexp_replace(digits, r"\s", ""), F.lit(")"))).otherwise(kind)
