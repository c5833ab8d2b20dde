"""Validation of a dataset as a project file describes it."""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from migcheck.operators import checksum, comparing, governance, inclusion, inference, keys, profile, schema, transforms
from migcheck.plans import loading, observer
from migcheck.plugins import Plugins
from migcheck.sources.incremental import incremental_load
from migcheck.sources.tables import read_source

# Governance settings of a project that states none.
DEFAULTS = {"max_null_percent": 10, "naming": governance.NAMING, "sample": 100, "required_fields": [], "green": 90, "yellow": 70}


@dataclass
class Result:
    name: str
    status: str
    penalty: float = 0.0
    severity: str = "INFO"
    details: dict = field(default_factory=dict)


def load_config(path: str) -> dict:
    """A JSON project file, with ${NAME:default} replaced from the environment."""
    with open(path) as file:
        text = file.read()
    return json.loads(re.sub(r"\$\{(\w+)(?::([^}]*))?\}", lambda m: os.environ.get(m[1], m[2] or ""), text))


@dataclass
class Dataset:
    """Both sides of a dataset with its mappings."""

    spark: SparkSession
    name: str
    config: dict
    legacy: DataFrame
    modern: DataFrame
    plugins: Plugins
    connections: dict = field(default_factory=dict)

    @classmethod
    def open(cls, spark: SparkSession, project: dict, name: str, plugins: Plugins | None = None) -> Dataset:
        plugins, own = plugins or Plugins(), project["datasets"][name]
        sides = (read_source(spark, project["connections"][own[s]["connection"]] | own[s], own[s].get("query", ""), plugins.readers) for s in ("legacy", "modern"))
        return cls(spark, name, DEFAULTS | project.get("validation", {}) | own, *sides, plugins, project["connections"])

    def mappings(self) -> DataFrame:
        changed = self.plugins.column_overrides.get(self.name, {})
        rows = [(m["source"], changed.get(m["source"], m.get("target")), m.get("type", "rename"), m.get("rationale")) for m in self.config.get("mappings", [])]
        return self.spark.createDataFrame(rows, "source string, target string, type string, rationale string")

    def other(self, source: dict) -> DataFrame:
        """Another table that the dataset's settings name by its connection."""
        return read_source(self.spark, self.connections[source["connection"]] | source, source.get("query", ""), self.plugins.readers)

    def schemas(self) -> tuple[DataFrame, DataFrame]:
        return schema.schema_of(self.spark, self.legacy), schema.schema_of(self.spark, self.modern)

    def key(self) -> tuple[str, str]:
        own = self.config["key"]
        return (own["legacy"], own["modern"]) if isinstance(own, dict) else (own, own)

    def pairs(self) -> list[tuple[str, str]]:
        found = schema.column_pairs(*self.schemas(), self.mappings()).collect()  # columns of one table
        return sorted((r["source"], r["target"]) for r in found if r["source"] != self.key()[0])


def listed(df: DataFrame, most: int = 100) -> list[dict]:
    """The first findings, for a report."""
    return [r.asDict() for r in df.limit(most).collect()]


def check_schema(d: Dataset) -> Result:
    diff = schema.schema_diff(*d.schemas())
    total = schema.schema_penalty(diff, d.mappings()).first()
    return Result("schema_diff", total["status"], total["penalty"], "HIGH", {"changes": listed(diff.where("change <> 'same'"))})


def check_governance(d: Dataset) -> Result:
    handled = d.mappings().where("type IN ('archived', 'transform')").select(F.col("source").alias("column_name"))
    found = governance.governance(d.legacy, d.schemas()[0], handled, d.config["required_fields"], d.config["max_null_percent"], d.config["naming"]).first()
    return Result("governance", found["status"], 0.0, "MEDIUM", found.asDict())


def check_quality(d: Dataset) -> Result:
    rules = d.config.get("rules", {}) | d.plugins.quality_rules.get(d.name, {})
    if not rules:
        return Result("data_quality", "SKIP")
    broken = listed(governance.broken_rules(d.legacy, rules).where("n > 0"))
    return Result("data_quality", "WARN" if broken else "PASS", 0.0, "MEDIUM", {"rules": broken})


def check_risk(d: Dataset) -> Result:
    strict = d.spark.createDataFrame([(c,) for c in d.config.get("not_null", [])], "column_name string")
    numbers = [f.name for f in d.legacy.schema.fields if isinstance(f.dataType, T.NumericType)]
    outliers = inference.outlier_columns(d.legacy, numbers) if numbers else None
    risks = listed(inference.profile_risks(profile.column_profile(d.legacy), strict, outliers))
    points = min(25, sum({"HIGH": 2, "MEDIUM": 1}.get(r["severity"], 0) for r in risks))
    return Result("profile_risk", "PASS" if not points else "WARN" if points < 10 else "FAIL", points, "MEDIUM", {"risks": risks})


def check_frame(d: Dataset) -> Result:
    """Values of the legacy side that do not cast to the stated ``types``, are null in ``not_null`` or repeat in ``unique`` columns."""
    types, required, unique = d.config.get("types", {}), d.config.get("not_null", []), d.config.get("unique", [])
    if not (types or required or unique):
        return Result("frame_schema", "SKIP")
    failures = listed(governance.schema_failures(d.legacy, types, required, unique).where("n > 0"))
    points = min(20, sum(f["n"] for f in failures))
    return Result("frame_schema", "FAIL" if points else "PASS", points, "MEDIUM", {"failures": failures})


def check_transforms(d: Dataset) -> Result:
    """The transform script of the dataset, a text or a file, against its mappings."""
    script = d.config.get("transform_script")
    if "transform_file" in d.config:
        with open(d.config["transform_file"]) as file:
            script = file.read()
    if script is None:
        return Result("etl_tests", "SKIP")
    scripts = d.spark.createDataFrame([(d.name, script)], "table string, script string")
    booleans = transforms.boolean_columns(d.legacy).withColumn("table", F.lit(d.name))
    issues = transforms.transform_issues(scripts, d.mappings().withColumn("table", F.lit(d.name)), booleans)
    total = transforms.transform_penalty(issues).first()
    severity = "HIGH" if total["penalty"] >= 10 else "MEDIUM" if total["n_issues"] else "INFO"
    return Result("etl_tests", total["status"], total["penalty"], severity, {"issues": listed(issues)})


def check_normalization(d: Dataset) -> Result:
    """A flat legacy table against the modern primary table and its ``children`` (a source, its column, the primary's key)."""
    children = [(d.other(c), c["column"], c.get("key", d.key()[1])) for c in d.config.get("children", [])]
    if not children:
        return Result("normalization_integrity", "SKIP")
    row = loading.normalization_integrity(d.legacy, d.modern, children).first()
    return Result("normalization_integrity", row["status"], row["penalty"], "HIGH", row.asDict())


def check_rows(d: Dataset) -> Result:
    row = comparing.row_count(d.legacy, d.modern).first()
    return Result("row_count", row["status"], row["penalty"], "HIGH", row.asDict())


def check_checksums(d: Dataset) -> Result:
    pairs = d.pairs()
    if not pairs:
        return Result("checksums", "SKIP")
    old = {r["column_name"]: (r["n"], r["checksum"]) for r in checksum.column_checksums(d.legacy, [a for a, _ in pairs]).collect()}
    new = {r["column_name"]: (r["n"], r["checksum"]) for r in checksum.column_checksums(d.modern, [b for _, b in pairs]).collect()}
    differ = [f"{a} -> {b}" for a, b in pairs if old[a] != new[b]]
    return Result("checksums", "WARN" if differ else "PASS", 0.0, "MEDIUM", {"differ": differ})


def check_references(d: Dataset) -> Result:
    """Keys of the modern table that its parents lack; without stated references, keys of its children that it lacks.

    ``"references": "derive"`` takes them from the data instead: columns of any table of the project (``tables``
    maps names to sources; the modern tables of this dataset by default) whose values are nearly all
    (``least_coverage``, 0.9) values of a unique column of another table.  A reference that cannot be checked
    is a finding and does not stop the others.
    """
    if d.config.get("references") == "derive":
        tables = {name: d.other(source) for name, source in d.config.get("tables", {}).items()} | {d.name: d.modern}
        likely = inclusion.references(inclusion.inclusions(tables), d.config.get("least_coverage", 0.9)).where(f"n_orphans > 0 AND (child_table = '{d.name}' OR parent_table = '{d.name}')")
        found = [{"column": f"{r['child_table']}.{r['child_column']}", "parent": f"{r['parent_table']}.{r['parent_column']}", "orphans": r["n_orphans"]} for r in listed(likely)]
        points = sum(min(f["orphans"], 20) for f in found)
        return Result("referential_integrity", "FAIL" if points else "PASS", points, "CRITICAL", {"checks": found})
    rules = [(d.modern, r["column"], r["parent"], r["parent"]["column"], True) for r in d.config.get("references", [])]
    rules = rules or [(d.modern, c["column"], c, c.get("key", d.key()[1]), False) for c in d.config.get("children", [])]
    if not rules:
        return Result("referential_integrity", "SKIP")
    found, points, failed = [], 0, False
    for own, column, source, key, is_parent in rules:
        try:
            other = d.other(source)
            n = (keys.orphan_keys(own, column, other, key) if is_parent else keys.orphan_keys(other, column, own, key)).count()
        except Exception as error:  # noqa: BLE001 - a reference that fails is a finding
            found.append({"column": column, "error": str(error)[:200]})
            failed = True
            continue
        found.append({"column": column, "orphans": n})
        points += min(n, 20)
    return Result("referential_integrity", "FAIL" if points else "WARN" if failed else "PASS", points, "CRITICAL", {"checks": found})


def check_sample(d: Dataset) -> Result:
    pairs = d.pairs()
    if not pairs:
        return Result("sample_compare", "SKIP")
    row = comparing.sample_compare(d.legacy, d.modern, d.key(), pairs, d.config["sample"]).first()
    differences = [] if row["match_rate"] == 100 else listed(comparing.sample_differences(d.legacy, d.modern, d.key(), pairs, d.config["sample"]))
    return Result("sample_compare", row["status"], row["penalty"], "HIGH", row.asDict() | {"differences": differences})


def check_aggregates(d: Dataset) -> Result:
    """Each aggregate has ``legacy`` and ``modern`` SQL over the views ``legacy`` and ``modern``, with the same columns."""
    rules = d.config.get("aggregates", []) + d.plugins.aggregates.get(d.name, [])
    if not rules:
        return Result("aggregates", "SKIP")
    d.legacy.createOrReplaceTempView("legacy")
    d.modern.createOrReplaceTempView("modern")
    bad = []
    for rule in rules:
        try:
            old, new = d.spark.sql(rule["legacy"]), d.spark.sql(rule["modern"])
            if "tolerance" in rule:
                compared = comparing.compare_groups(old, new, rule.get("keys", []), rule["values"], rule["tolerance"])
                differs = compared.where("NOT agrees").limit(1).count()
            else:
                differs = old.exceptAll(new).union(new.exceptAll(old)).limit(1).count()
            if differs:
                bad.append({"name": rule["name"], "problem": "differs"})
        except Exception as error:  # noqa: BLE001 - a rule that fails is a finding
            bad.append({"name": rule["name"], "problem": str(error)[:200]})
    return Result("aggregates", "FAIL" if bad else "PASS", 10.0 * len(bad), "HIGH", {"aggregates": bad})


def check_leakage(d: Dataset) -> Result:
    names = [r["column_name"] for r in schema.archived_leakage(d.schemas()[1], d.mappings()).collect()]
    return Result("archived_leakage", "FAIL" if names else "PASS", min(20 * len(names), 40), "CRITICAL", {"columns": names})


def check_unmapped(d: Dataset) -> Result:
    names = [r["column_name"] for r in schema.unmapped_columns(d.schemas()[1], d.mappings()).collect()]
    return Result("unmapped_columns", "WARN" if names else "PASS", min(5 * len(names), 15), "MEDIUM", {"columns": names})


def check_encoding(d: Dataset) -> Result:
    texts = [c for c, kind in d.modern.dtypes if kind == "string"]
    found = listed(governance.encoding_issues(d.modern, texts)) if texts else []
    points = min(20, sum(1 if f["kind"] == "replacement" else 3 for f in found))
    return Result("encoding", "PASS" if not points else "FAIL" if points >= 10 else "WARN", points, "HIGH", {"issues": found})


PRE: list[Callable[[Dataset], Result]] = [check_schema, check_governance, check_quality, check_risk, check_frame, check_transforms]
POST: list[Callable[[Dataset], Result]] = [
    check_rows, check_checksums, check_sample, check_aggregates, check_leakage, check_unmapped, check_encoding, check_normalization, check_references,
]


def validate(spark: SparkSession, project: dict, name: str, phase: str, plugins: Plugins | None = None) -> dict:
    """Run a phase: {dataset, phase, score, status, results}."""
    d = Dataset.open(spark, project, name, plugins)
    results = [check(d) for check in (PRE if phase == "pre" else POST)]
    results += [f(spark, d.legacy, d.modern, d.config) for f in d.plugins.validators[phase]]
    score = max(0.0, 100.0 - sum(r.penalty for r in results))
    if phase == "pre":
        governed = next(r.details["score"] for r in results if r.name == "governance")
        score = 0.4 * score + 0.4 * 100 + 0.2 * governed
    score = round(d.plugins.adjusted(phase, score, results), 2)
    status = "GREEN" if score >= d.config["green"] else "YELLOW" if score >= d.config["yellow"] else "RED"
    return {"dataset": name, "phase": phase, "score": score, "status": status, "results": [asdict(r) for r in results]}


def observe(spark: SparkSession, project: dict, baseline: str, now: str, alerts: str, plugins: Plugins | None = None, set_baseline: bool = False) -> int:
    """Hold every dataset's modern table against the stored baseline and hand on the alerts; how many there were.

    With ``set_baseline`` the baseline is written anew and nothing is observed; without a stored one it is an error.
    A project with ``"sketches": true`` keeps sketches of all columns too and is told when their values drift.
    """
    plugins = plugins or Plugins()
    tables = {name: Dataset.open(spark, project, name, plugins).modern for name in project["datasets"]}
    if set_baseline:
        observer.save_baseline(tables, baseline)
        if project.get("sketches"):
            observer.save_sketches(tables, f"{baseline}-sketches")
        return 0
    findings = observer.observe(tables, observer.load_baseline(spark, baseline), now)
    if project.get("sketches"):
        findings = findings.union(observer.distribution_drift(tables, f"{baseline}-sketches"))
    for check in plugins.observer_checks:
        for name, df in tables.items():
            findings = findings.unionByName(check(spark, name, df))
    return observer.dispatch(findings, alerts, plugins.on_drift)


STRATEGIES = ("full_load", "incremental", "external")


def ingest_plan(project: dict, plugins: Plugins | None = None) -> list[tuple[str, str]]:
    """(dataset, strategy) in the order of loading: a plugin's strategy, else the dataset's, else a full load."""
    chosen = [(name, (plugins or Plugins()).ingest_strategies.get(name, own.get("strategy", "full_load"))) for name, own in project["datasets"].items()]
    for name, strategy in chosen:
        if strategy not in STRATEGIES:
            raise ValueError(f"unknown strategy {strategy!r} of {name}; known: {', '.join(STRATEGIES)}")
    return chosen


def ingest(spark: SparkSession, project: dict, target: str, plugins: Plugins | None = None) -> dict[str, str]:
    """Load the legacy side of every dataset below ``target``; status by dataset.

    A full load is made once; an incremental one (``incremental``: changed_at, partition) takes what is new at
    each call; an external one is left to another system and only noted.
    """
    plugins = plugins or Plugins()
    plan = ingest_plan(project, plugins)
    full = [(name, Dataset.open(spark, project, name, plugins).legacy, f"{target}/{name}") for name, strategy in plan if strategy == "full_load"]
    state = loading.resume_loads(full, f"{target}/_state")
    for name, strategy in plan:
        if strategy == "external":
            state[name] = "external"
        elif strategy == "incremental":
            d = Dataset.open(spark, project, name, plugins)
            taken = incremental_load(d.legacy, f"{target}/{name}", d.key()[0], d.config["incremental"]["changed_at"], d.config["incremental"]["partition"])
            state[name] = f"completed: {taken['changes']} changes"
    for callback in plugins.post_ingest:
        for name, status in state.items():
            callback(name, status)
    return state


def write_report(run: dict, folder: str, plugins: Plugins | None = None) -> str:
    """Write a run's metadata, findings and a readable report into a folder of its own."""
    path = os.path.join(folder, f"run_{datetime.now(timezone.utc):%Y-%m-%d_%H-%M-%S}_{uuid.uuid4().hex[:6]}")
    os.makedirs(path)
    with open(os.path.join(path, "run_metadata.json"), "w") as file:
        json.dump(run | {"timestamp": datetime.now(timezone.utc).isoformat()}, file, indent=1, default=str)
    lines = [f"# {run['dataset']}, {run['phase']}: {run['score']} {run['status']}", "", "| Check | Status | Penalty | Severity |", "|---|---|---|---|"]
    lines += [f"| {r['name']} | {r['status']} | {r['penalty']} | {r['severity']} |" for r in run["results"]]
    lines += [line for section in (plugins or Plugins()).report_sections for line in section(run)]
    with open(os.path.join(path, "report.md"), "w") as file:
        file.write("\n".join(lines) + "\n")
    return path


def read_runs(spark: SparkSession, folder: str) -> DataFrame:
    """All runs below a folder, as run_id, run_date, dataset, phase, score."""
    rows = spark.read.option("multiLine", True).json(os.path.join(folder, "*", "run_metadata.json"))
    run_id = F.regexp_extract(F.input_file_name(), r"/(run_[^/]+)/", 1)
    return rows.select(run_id.alias("run_id"), F.substring("timestamp", 1, 10).alias("run_date"), "dataset", "phase", F.col("score").cast("double").alias("score"))
