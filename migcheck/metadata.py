"""What a project knows of its tables, found and written as JSON lines: glossary, mappings, profiles, plans, references, scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from migcheck.operators import inclusion, mapping, normalize, repeated
from migcheck.operators.profile import column_profile
from migcheck.operators.schema import schema_of
from migcheck.plans import monitor
from migcheck.plugins import Plugins
from migcheck.project import Dataset
from migcheck.sources import discovery

OVERRIDES = "table string, source string, target string, type string"


def every(frames) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def columns_of(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """table, column_name, data_type."""
    return every(schema_of(spark, df).select(F.lit(name).alias("table"), "column_name", "data_type") for name, df in tables.items())


def write(df: DataFrame, folder: str, name: str) -> None:
    """One kind of metadata, a row a column or a table, as JSON lines."""
    df.coalesce(1).write.mode("overwrite").json(f"{folder}/{name}")


def discover(spark: SparkSession, project: dict, folder: str, plugins: Plugins | None = None) -> dict[str, DataFrame]:
    """glossary, mappings, profile, plan, lookups and references of all datasets; each is written below ``folder`` too.

    Stated mappings come before found ones.  The plan is of the legacy tables; a dataset's override
    (a function of its part of the plan) has the last word.  References are between the modern tables.
    """
    plugins = plugins or Plugins()
    sets = {name: Dataset.open(spark, project, name, plugins) for name in project["datasets"]}
    legacy, modern = {n: d.legacy for n, d in sets.items()}, {n: d.modern for n, d in sets.items()}
    old = columns_of(spark, legacy)
    sources = old.withColumnRenamed("column_name", "source")
    targets = columns_of(spark, modern).select("table", F.col("column_name").alias("target"))
    stated = [(n, m["source"], m.get("target"), m.get("type", "rename")) for n, d in sets.items() for m in d.config.get("mappings", [])]
    profile = every(column_profile(df).withColumn("table", F.lit(name)) for name, df in legacy.items())
    found = [(name, column) for name, df in legacy.items() for column in repeated.lookup_columns(df)]
    groups = normalize.column_groups(old.select("table", "column_name"))
    lookups = spark.createDataFrame(found, "table string, column_name string").join(groups.select("table", "column_name", "prefix"), ["table", "column_name"])
    plan = normalize.normalization_plan(normalize.entity_keys(normalize.sub_entities(groups), profile), lookups)
    for name, change in plugins.normalization_overrides.items():
        plan = plan.where(F.col("table") != name).unionByName(change(plan.where(F.col("table") == name)))
    glossary = mapping.glossary(sources)
    for enrich_ in plugins.glossary_enrichers:
        glossary = enrich_(glossary)
    out = {
        "glossary": glossary,
        "mappings": mapping.build_mappings(sources, targets, spark.createDataFrame(stated, OVERRIDES)),
        "profile": profile,
        "plan": plan,
        "lookups": lookups,
        "references": inclusion.references(inclusion.inclusions(modern)),
    }
    for name, df in out.items():
        write(df, folder, name)
    return out


def enrich(spark: SparkSession, folder: str, catalog: str, terms: str | None = None) -> DataFrame:
    """The glossary of :func:`discover` with a catalog's descriptions, tags and, where ``terms`` are given, glossary terms of the same name.

    It is written as ``enriched``.  A catalog's description is certain (confidence 1); a tag that names
    personal data makes a column personal.
    """
    own = spark.read.json(f"{folder}/glossary")
    known = discovery.read_catalog(spark, catalog).select("table", F.col("column_name").alias("name"), F.col("description").alias("said"), "tags")
    personal = F.exists(F.coalesce("tags", F.array().cast("array<string>")), lambda tag: F.lower(tag).startswith("pii"))
    joined = own.withColumn("lower_", F.lower("name")).join(known.withColumnRenamed("name", "lower_"), ["table", "lower_"], "left")
    said = F.when(F.trim("said") != "", F.col("said"))
    out = joined.select(
        "table", "name", "system", F.coalesce(said, "description").alias("description"), "data_type", (F.col("pii") | F.coalesce(personal, F.lit(False))).alias("pii"),
        F.when(said.isNotNull(), 1.0).otherwise(F.col("confidence")).alias("confidence"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags"),
    )
    if terms:
        listed = discovery.read_catalog_glossary(spark, terms).select(F.col("term").alias("lower_"), "display_name")
        out = out.withColumn("lower_", F.lower("name")).join(listed, "lower_", "left").withColumnRenamed("display_name", "term").drop("lower_")
    write(out, folder, "enriched")
    return spark.read.json(f"{folder}/enriched")


def rationalize(spark: SparkSession, project: dict, folder: str, catalog: str | None = None, plugins: Plugins | None = None) -> DataFrame:
    """table, score, recommendation of every legacy table, best first; written as ``scope``.

    ``usage`` of a dataset's settings states query_count, age_days and tier_score where they are known;
    downstream tables come from a catalog's lineage, completeness from the rows.  A table's override
    replaces its recommendation.
    """
    plugins = plugins or Plugins()
    sets = {name: Dataset.open(spark, project, name, plugins) for name in project["datasets"]}
    full = monitor.completeness(every(column_profile(d.legacy).withColumn("table", F.lit(name)) for name, d in sets.items()))
    usage = [(n, *(d.config.get("usage", {}).get(k) for k in ("query_count", "age_days")), float(d.config.get("usage", {}).get("tier_score", 50))) for n, d in sets.items()]
    stats = spark.createDataFrame(usage, "table string, query_count long, age_days int, tier_score double").join(full, "table")
    if catalog:
        stats = stats.join(monitor.downstream_count(discovery.read_catalog_lineage(spark, catalog)), "table", "left")
        stats = stats.withColumn("n_downstream", F.coalesce("n_downstream", F.lit(0)))
    else:
        stats = stats.withColumn("n_downstream", F.lit(0))
    scored = monitor.rationalize(stats)
    for name, advice in plugins.rationalization_overrides.items():
        scored = scored.withColumn("recommendation", F.when(F.col("table") == name, advice).otherwise(F.col("recommendation")))
    scored = scored.orderBy(F.desc("score"), "table")
    write(scored, folder, "scope")
    return scored


def write_governance(run: dict, spark: SparkSession, folder: str) -> None:
    """The governance findings of a validation run (see :func:`migcheck.project.validate`) as CSV: check, kind, item, detail."""
    rows = [
        (r["name"], kind, str(item.get("column_name", "")) if isinstance(item, dict) else str(item), str(item))
        for r in run["results"] if r["name"] in ("governance", "data_quality", "archived_leakage", "unmapped_columns")
        for kind, items in r["details"].items() if isinstance(items, list)
        for item in items
    ]
    spark.createDataFrame(rows, "check string, kind string, item string, detail string").coalesce(1).write.mode("overwrite").option("header", True).csv(folder)
