"""Incremental loads into partitioned tables: high-water marks, late and out-of-order changes, only touched partitions rewritten."""

from __future__ import annotations

from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from migcheck.operators.comparing import one_per_key
from migcheck.sources.shared import shared_dir


def read_mark(spark: SparkSession, path: str) -> datetime | None:
    """The latest change that was loaded; None before the first load."""
    try:
        return spark.read.schema("mark timestamp_ntz").json(f"{path}/_mark").agg(F.max("mark")).first()[0]
    except AnalysisException:  # nothing was loaded yet
        return None


def stored(df: DataFrame, name: str) -> DataFrame:
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of whatever file system Spark knows."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def incremental_load(source: DataFrame, path: str, key: str, changed_at: str, partition: str, late: str = "1 day") -> dict[str, int]:
    """Bring a table (``path``/data, partitioned by ``partition``) up to date; numbers of changes taken and partitions rewritten.

    Rows of ``source`` changed after the mark less ``late`` are looked at.  Of several changes of a key the
    latest counts, and one that is older than what the table has is passed over.  A row that changes its
    partition leaves the old one.  The mark moves last: a load that failed is simply run again.  Rows
    without a key, a time of change or a partition are left out.
    """
    spark = source.sparkSession
    mark, data = read_mark(spark, path), f"{path}/data"
    known = source.where(F.col(key).isNotNull() & F.col(changed_at).isNotNull() & F.col(partition).isNotNull())
    if mark is not None:
        known = known.where(F.col(changed_at) > F.lit(mark).cast("timestamp_ntz") - F.expr(f"INTERVAL {late}"))
    others = [F.col(c).desc_nulls_last() for c in source.columns if c not in (key, changed_at)]
    changes = stored(one_per_key(known, key, [F.col(changed_at).desc(), *others]), "changes")
    if mark is None:
        changes.write.mode("overwrite").partitionBy(partition).parquet(data)
        touched = changes.select(partition).distinct().count()
    else:
        kind = source.schema[partition].dataType
        current = spark.read.parquet(data).withColumn(partition, F.col(partition).cast(kind)).select(*source.columns)
        was = current.select(F.col(key).alias("key_"), F.col(changed_at).alias("was_"), F.col(partition).alias("from_"))
        met = changes.join(was, F.col(key) == F.col("key_"), "left")
        changes = stored(met.where(F.col("was_").isNull() | (F.col(changed_at) > F.col("was_"))).drop("key_", "was_"), "taken")
        both = changes.select(F.explode(F.array(partition, "from_")).alias(partition)).where(F.col(partition).isNotNull()).distinct()
        names = stored(both, "touched")
        changes = changes.drop("from_")
        kept = current.join(names, partition, "left_semi").join(changes.select(key), key, "left_anti")
        rows = stored(kept.select(*source.columns).unionByName(changes), "rewritten")  # read in full before any file is replaced
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(data)
        for row in names.join(rows.select(partition).distinct(), partition, "left_anti").collect():  # partitions that lost their last row
            remove(spark, f"{data}/{partition}={row[0]}")
        touched = names.count()
    latest = changes.agg(F.max(changed_at).cast("timestamp_ntz").alias("mark"), F.count("*").alias("n")).first()
    if latest["mark"] is not None:
        spark.createDataFrame([(latest["mark"],)], "mark timestamp_ntz").coalesce(1).write.mode("append").json(f"{path}/_mark")
    return {"changes": latest["n"], "partitions": touched}
