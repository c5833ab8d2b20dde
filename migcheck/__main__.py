"""Command line: python -m migcheck {discover,enrich,rationalize,validate,profile,status,prove,observe,ingest} ..."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from migcheck import metadata
from migcheck import project as p
from migcheck.operators.profile import column_profile
from migcheck.plans.runs import latest_runs, run_status
from migcheck.plans.scoring import proof_score


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="migcheck")
    commands = parser.add_subparsers(dest="command", required=True)
    check = commands.add_parser("validate")
    check.add_argument("project")
    check.add_argument("dataset")
    check.add_argument("--phase", choices=("pre", "post"), default="post")
    check.add_argument("--runs", default="runs")
    look = commands.add_parser("profile")
    look.add_argument("project")
    look.add_argument("dataset")
    look.add_argument("--side", choices=("legacy", "modern"), default="legacy")
    past = commands.add_parser("status")
    past.add_argument("--runs", default="runs")
    proof = commands.add_parser("prove", help="the mean of each dataset's latest pre and post scores")
    proof.add_argument("--runs", default="runs")
    watch = commands.add_parser("observe", help="the modern tables against a stored baseline")
    watch.add_argument("project")
    watch.add_argument("--baseline", required=True)
    watch.add_argument("--alerts", required=True)
    watch.add_argument("--now", required=True, help="time of the observation, such as '2026-01-01 00:00:00'")
    watch.add_argument("--set-baseline", action="store_true", help="write the baseline and observe nothing")
    load = commands.add_parser("ingest", help="load the legacy side of every dataset that is not loaded yet")
    load.add_argument("project")
    load.add_argument("--target", required=True)
    load.add_argument("--plan-only", action="store_true", help="show the order and strategies and load nothing")
    find = commands.add_parser("discover", help="glossary, mappings, profiles, a normalisation plan and references of all datasets")
    rate = commands.add_parser("rationalize", help="which tables are worth migrating")
    for one in (find, rate):
        one.add_argument("project")
        one.add_argument("--metadata", default="metadata")
    rate.add_argument("--catalog")
    more = commands.add_parser("enrich", help="a discovered glossary with a catalog's descriptions and tags")
    more.add_argument("catalog")
    more.add_argument("--metadata", default="metadata")
    more.add_argument("--terms")
    own = parser.parse_args(args)
    spark = SparkSession.builder.appName("migcheck").getOrCreate()
    if own.command == "status":
        run_status(p.read_runs(spark, own.runs)).show(truncate=False)
        return 0
    if own.command == "prove":
        proof_score(latest_runs(p.read_runs(spark, own.runs))).show(1000, truncate=False)
        return 0
    if own.command == "enrich":
        metadata.enrich(spark, own.metadata, own.catalog, own.terms).show(1000, truncate=False)
        return 0
    config = p.load_config(own.project)
    if own.command == "discover":
        for name, df in metadata.discover(spark, config, own.metadata).items():
            print(name)
            df.show(1000, truncate=False)
        return 0
    if own.command == "rationalize":
        metadata.rationalize(spark, config, own.metadata, own.catalog).show(1000, truncate=False)
        return 0
    if own.command == "ingest" and own.plan_only:
        print(p.ingest_plan(config))
        return 0
    if own.command == "observe":
        return int(p.observe(spark, config, own.baseline, own.now, own.alerts, set_baseline=own.set_baseline) > 0)
    if own.command == "ingest":
        state = p.ingest(spark, config, own.target)
        print(state)
        return int("failed" in state.values())
    if own.command == "profile":
        column_profile(getattr(p.Dataset.open(spark, config, own.dataset), own.side)).show(1000, truncate=False)
        return 0
    run = p.validate(spark, config, own.dataset, own.phase)
    print(run["dataset"], run["phase"], run["score"], run["status"], p.write_report(run, own.runs))
    return int(run["status"] == "RED")


if __name__ == "__main__":
    sys.exit(main())
