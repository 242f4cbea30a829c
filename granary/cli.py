"""Commands over files: cleaning, customers, audits, models, the landing area, runs, reports, and registered queries.

Each command reads Parquet or CSV, writes to a new path, and prints one JSON line. Sizes and places of staged tables come from the
session's own configuration (spark-submit), never from here.
"""

from __future__ import annotations

import argparse
import json
from collections.abc import Sequence
from datetime import date

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary import session
from granary.operators import audit, clean, dates, lineage, ml, orders, publish, reports, rfm, store
from granary.schema import COLUMNS, require_types
from granary.sources import landing, readers, tables
from granary.sources.storage import separate, write_once


def transactions(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    df = readers.typed_csv(spark, path, encoding) if path.lower().endswith(".csv") else spark.read.parquet(path).select(*COLUMNS)
    require_types(df)
    return df


def run_clean(spark: SparkSession, a: argparse.Namespace) -> dict:
    separate(a.input, a.output)
    kept, distinct = clean.prepared(transactions(spark, a.input, a.encoding))
    write_once(kept, a.output)
    if a.audit_output:
        separate(a.input, a.audit_output)
        separate(a.output, a.audit_output)
        write_once(distinct, a.audit_output)
    return {"rows": spark.read.parquet(a.output).count()}


def run_metrics(spark: SparkSession, a: argparse.Namespace) -> dict:
    separate(a.input, a.output)
    history = clean.metrics_history(transactions(spark, a.input, a.encoding), a.run_date)
    first = history.agg(F.to_date(F.min("InvoiceDate"))).first()[0]
    scored = rfm.scores(rfm.metrics(history, a.run_date))
    if a.model:
        scored = ml.assign(PipelineModel.load(a.model), scored, a.model_version)
    found = rfm.labels(scored, (date.fromisoformat(a.run_date) - first).days if first else 0)
    write_once(found, a.output)
    return {"customers": spark.read.parquet(a.output).count()}


def run_audit(spark: SparkSession, a: argparse.Namespace) -> dict:
    separate(a.input, a.output)
    rows = transactions(spark, a.input, a.encoding)
    write_once(audit.audit(rows, a.run_date), a.output)
    written = spark.read.parquet(a.output)
    audit.require_audit_contract(written, rows, a.run_date)
    return {"rows": written.count(), "flagged": written.where("assessment_status = 'flagged'").count()}


def run_orders(spark: SparkSession, a: argparse.Namespace) -> dict:
    separate(a.input, a.output)
    write_once(orders.assess_orders(transactions(spark, a.input, a.encoding), a.run_date), a.output)
    return {"orders": spark.read.parquet(a.output).count()}


def run_ingest(spark: SparkSession, a: argparse.Namespace) -> dict:
    rows = transactions(spark, a.input, a.encoding)
    manifest = store.Store(spark, a.root).ingest(rows, a.batch, a.run_date, initialize=a.initialize, buckets=a.buckets)
    return {"version": manifest["version"]}


def run_train(spark: SparkSession, a: argparse.Namespace) -> dict:
    metrics = rfm.metrics(clean.metrics_history(transactions(spark, a.input, a.encoding), a.run_date), a.run_date)
    ml.save_checked(ml.fit_kmeans(metrics, a.k, a.seed), a.output, metrics)
    return {"k": a.k, "path": a.output}


def run_choose_k(spark: SparkSession, a: argparse.Namespace) -> dict:
    metrics = rfm.metrics(clean.metrics_history(transactions(spark, a.input, a.encoding), a.run_date), a.run_date)
    found = ml.sweep(metrics, a.k_max, a.seed).orderBy("k")
    tables.write_text(spark, a.output, tables.comma_separated(found))
    return {"path": a.output}


def run_land(spark: SparkSession, a: argparse.Namespace) -> dict:
    manifest = landing.split(spark, a.input, a.root, a.version, a.encoding)
    return {x: manifest[x] for x in ("version", "rows", "first_date", "last_date")}


def run_day(spark: SparkSession, a: argparse.Namespace) -> dict:
    space = publish.Workspace(spark, a.root)
    day = dates.business_date(a.business_date, manual=True)
    context = space.context(a.pipeline, a.run_id, day, a.version, k=a.k, model_version=a.model_version, kind="bootstrap" if a.stage == "train" else "daily")
    if a.stage == "train":
        space.run_etl(context)
        found = space.train(context, a.k or 3, a.model_version)
        space.activate(a.model_version, a.effective_from or dates.training_cutoff(context["run_date"], manual=True)[1])
    elif a.stage == "all":
        found = space.daily(context)
    else:
        found = {"etl": space.run_etl, "rfm": space.run_rfm, "audit": space.run_audit, "publish": space.publish}[a.stage](context)
    if a.lineage:
        lineage.publish(space, context)
    return {"run_key": context["run_key"], "stage": a.stage, "hash": publish.json_hash(found)}


def run_report(spark: SparkSession, a: argparse.Namespace) -> dict:
    written = spark.read.parquet(a.input)
    checks = audit.exploded(written, "record_type", "channel")
    sections = [
        ("Status and severity", reports.status_severity(written).orderBy("assessment_status", "max_severity")),
        ("Types by channel", reports.pivot_counts(written, "record_type", "channel", list(audit.CHANNELS)).orderBy("record_type")),
        ("Flagged lines by rule", checks.where("status = 'flagged'").groupBy("rule", "severity").agg(F.count("*").alias("rows")).orderBy("rule", "severity")),
        ("Rules not applied", checks.where("status = 'not_applied'").groupBy("rule", "reason").agg(F.count("*").alias("rows")).orderBy("rule", "reason")),
    ]
    tables.write_text(spark, a.output, tables.document(sections, "Audit"))
    return {"path": a.output}


def run_query(spark: SparkSession, a: argparse.Namespace) -> dict:
    from granary import plans

    write_once(plans.queries()[a.name](spark, a.input), a.output)
    return {"rows": spark.read.parquet(a.output).count()}


#: Command: what runs it, and its arguments beside each other; a name without dashes is required.
ROWS = {"input": {}, "output": {}, "--encoding": {"default": "UTF-8"}}
DATED = ROWS | {"--run-date": {"required": True, "help": "exclusive cutoff"}}
SEED = {"--seed": {"type": int, "default": 42}}
COMMANDS = {
    "clean": (run_clean, ROWS | {"--audit-output": {"help": "distinct rows before the filter"}}),
    "metrics": (run_metrics, DATED | {"--model": {}, "--model-version": {"default": "unversioned"}}),
    "audit": (run_audit, DATED),
    "orders": (run_orders, DATED),
    "ingest": (run_ingest, {"input": {}, "root": {}, "batch": {}, "--run-date": {"required": True}, "--initialize": {"action": "store_true"}, "--buckets": {"type": int}, "--encoding": {"default": "UTF-8"}}),
    "train": (run_train, DATED | SEED | {"--k": {"type": int, "required": True}}),
    "choose-k": (run_choose_k, DATED | SEED | {"--k-max": {"type": int, "default": 10}}),
    "land": (run_land, {"input": {}, "root": {}, "version": {}, "--encoding": {"default": "cp1252"}}),
    "run": (run_day, {
        "root": {}, "version": {}, "stage": {"choices": ["train", "etl", "rfm", "audit", "publish", "all"]}, "--business-date": {"required": True}, "--pipeline": {"default": "daily"}, "--run-id": {"required": True},
        "--k": {"type": int}, "--model-version": {}, "--effective-from": {}, "--lineage": {"action": "store_true"},
    }),
    "report": (run_report, {"input": {}, "output": {}}),
    "query": (run_query, {"name": {}, "input": {}, "output": {}}),
}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="granary", description=__doc__.splitlines()[0])
    commands = top.add_subparsers(dest="command", required=True)
    for name, (_, arguments) in COMMANDS.items():
        one = commands.add_parser(name)
        for argument, options in arguments.items():
            one.add_argument(argument, **options)
    return top


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    if a.command == "run" and a.stage == "train" and not a.model_version:
        parser().error("run train: --model-version names the new model")
    print(json.dumps(COMMANDS[a.command][0](spark or session.build(f"granary {a.command}"), a), sort_keys=True))
    return 0
