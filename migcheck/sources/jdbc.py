"""Databases over JDBC: partitioned reads whose bounds the source gives, statistics worked out by the source, and loads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# The drivers' classes.
DRIVERS = {
    "postgres": "org.postgresql.Driver", "postgresql": "org.postgresql.Driver", "db2": "com.ibm.db2.jcc.DB2Driver",
    "oracle": "oracle.jdbc.OracleDriver", "derby": "org.apache.derby.iapi.jdbc.AutoloadedDriver",
}


def jdbc_url(config: dict) -> str:
    if "url" in config:
        return config["url"]
    host, port, name = config.get("host"), config.get("port"), config.get("database", "")
    kind = config["type"]
    if kind == "derby":
        return f"jdbc:derby:{name};create=true"
    if kind == "oracle":
        return f"jdbc:oracle:thin:@{host}:{port or 1521}" + (f":{config['sid']}" if "sid" in config else f"/{config.get('service_name', name)}")
    if kind == "db2":
        ssl = ":sslConnection=true;" if config.get("ssl") else ""
        return f"jdbc:db2://{host}:{port or 50000}/{name}{ssl}"
    return f"jdbc:postgresql://{host}:{port or 5432}/{name}"


def options(config: dict) -> dict[str, str]:
    """Connection, time-out and current schema as options of Spark's JDBC source."""
    out = {"url": jdbc_url(config), "driver": config.get("driver") or DRIVERS[config["type"]], "user": config.get("user", ""), "password": config.get("password", "")}
    if "timeout" in config:
        out["queryTimeout"] = str(config["timeout"])
    if "schema" in config:
        statement = {"db2": "SET SCHEMA {}", "oracle": "ALTER SESSION SET CURRENT_SCHEMA = {}", "derby": "SET SCHEMA {}"}.get(config["type"], "SET search_path TO {}")
        out["sessionInitStatement"] = statement.format(config["schema"])
    return {k: v for k, v in out.items() if v != ""}


def ask(spark: SparkSession, config: dict, query: str) -> DataFrame:
    """The result of a query that the source runs as a whole."""
    return spark.read.format("jdbc").options(**options(config)).option("query", query).load()


def source_of(query: str) -> str:
    """A query or a table's name as something to select from."""
    return f"({query}) q" if query.lstrip().lower().startswith(("select", "with")) else query


def quoted(name: str) -> str:
    """A column's name as the source wrote it into the schema."""
    return '"' + name.replace('"', '""') + '"'


def read_jdbc(spark: SparkSession, config: dict, query: str) -> DataFrame:
    """A query or table, read in parallel; filters, column lists and limits on the result go to the source.

    The ranges are of ``partition_column``, else of the first whole-number column; bounds that are not
    given are the source's own least and greatest value.  Only a result without such a column is
    read by one task.
    """
    reader = spark.read.format("jdbc").options(**options(config)).option("dbtable", source_of(query)).option("fetchsize", config.get("fetch_size", 10_000))
    wanted, fields = config.get("partition_column"), reader.load().schema.fields
    column = next((f.name for f in fields if (f.name.lower() == wanted.lower() if wanted else isinstance(f.dataType, T.IntegralType))), wanted)
    if column is None:
        return reader.load()
    low, high = config.get("lower_bound"), config.get("upper_bound")
    if low is None or high is None:
        row = ask(spark, config, f"SELECT MIN({quoted(column)}) AS lo, MAX({quoted(column)}) AS hi FROM {source_of(query)}").first()
        low, high = row[0] if low is None else low, row[1] if high is None else high
    if low is None or high is None:  # no rows, or nulls only
        return reader.load()
    parts = config.get("partitions", 32)
    return reader.option("partitionColumn", column).option("lowerBound", low).option("upperBound", int(high) + 1 if isinstance(high, int) else high).option("numPartitions", parts).load()


def column_statistics(spark: SparkSession, config: dict, query: str, columns: list[str]) -> DataFrame:
    """column_name, n, n_null, n_distinct, n_repeated (values that repeat), all counted by the source: a row a column comes back."""
    source = source_of(query)
    parts = [
        f"""SELECT '{c}' AS column_name, SUM(n) AS n, SUM(CASE WHEN v IS NULL THEN n ELSE 0 END) AS n_null, COUNT(v) AS n_distinct,
        SUM(CASE WHEN n > 1 AND v IS NOT NULL THEN 1 ELSE 0 END) AS n_repeated FROM (SELECT {quoted(c)} AS v, COUNT(*) AS n FROM {source} GROUP BY {quoted(c)}) s"""
        for c in columns
    ]
    found = ask(spark, config, " UNION ALL ".join(parts)).toDF("column_name", "n", "n_null", "n_distinct", "n_repeated")
    return found.selectExpr("trim(column_name) AS column_name", *(f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}" for c in found.columns[1:]))


def orphans(spark: SparkSession, config: dict, child: tuple[str, str], parent: tuple[str, str]) -> DataFrame:
    """n_orphans, n_null_keys of a child's (table, column) against a parent's, counted by the source; a null key is an orphan."""
    (table, column), (other, key) = child, parent
    column, key = quoted(column), quoted(key)
    query = f"SELECT COUNT(*) AS n_orphans, SUM(CASE WHEN c.{column} IS NULL THEN 1 ELSE 0 END) AS n_null_keys FROM {table} c LEFT JOIN {other} p ON c.{column} = p.{key} WHERE p.{key} IS NULL"
    return ask(spark, config, query).toDF("n_orphans", "n_null_keys").selectExpr("CAST(n_orphans AS BIGINT) AS n_orphans", "CAST(coalesce(n_null_keys, 0) AS BIGINT) AS n_null_keys")


def write_jdbc(df: DataFrame, config: dict, table: str, mode: str = "truncate", types: str | None = None) -> None:
    """Load a table: ``truncate`` empties it and keeps its definition, ``overwrite`` makes it anew, ``append`` adds.

    Rows are written in batches by as many connections as ``partitions`` says; ``types`` (``name VARCHAR(20), ...``)
    are of columns of a table that is made anew.
    """
    writer = df.write.format("jdbc").options(**options(config)).option("dbtable", table)
    writer = writer.option("batchsize", config.get("batch_size", 10_000)).option("numPartitions", config.get("partitions", 8))
    writer = writer.option("createTableColumnTypes", types) if types else writer
    writer.option("truncate", str(mode == "truncate").lower()).mode("append" if mode == "append" else "overwrite").save()
