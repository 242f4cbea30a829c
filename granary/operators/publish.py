"""Runs, stages and models as documents: frozen contexts, hash-bound stage manifests, atomic publication, a model registry.

Every document is written once and whole. A stage manifest carries the hash of the context it ran under, both analytic branches carry the
hash of the cleaning stage they read, and a day is published only when all of them agree.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable
from datetime import date, timedelta
from pathlib import Path

from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from granary.config import DEFAULT, Config
from granary.operators import audit, clean, ml, orders, rfm
from granary.schema import COLUMNS, ContractError
from granary.sources import landing
from granary.sources.storage import Files, write_once

STAGES = ("etl", "rfm", "audit")


def json_hash(value: object) -> str:
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def code_hash() -> str:
    """Of the library's own sources."""
    root = Path(__file__).resolve().parent.parent
    return json_hash({str(p.relative_to(root)): hashlib.sha256(p.read_bytes()).hexdigest() for p in sorted(root.rglob("*.py")) if "llm" not in p.relative_to(root).parts})


class Workspace:
    """Documents and outputs under one root."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.files, self.root = spark, Files(spark, root), root.rstrip("/")

    def run_file(self, run_key: str, name: str) -> str:
        if not re.fullmatch("[0-9a-f]{64}", run_key):
            raise ValueError("run keys are 64 hex digits")
        return self.files.at("manifests", "runs", run_key, f"{name}.json")

    def write(self, name: str, value: dict) -> None:
        self.files.fs.mkdirs(self.files.path(name.rsplit("/", 1)[0]))
        self.files.write_json(name, value)

    # ---------------------------------------------------------------------------------- contexts

    def context(self, pipeline: str, run_id: str, business_date: str, source_version: str, churn_days: int = 90, k: int | None = None, model_version: str | None = None, kind: str = "daily") -> dict:
        """The frozen inputs of a run; the same run with other inputs is an error."""
        if kind not in ("daily", "bootstrap"):
            raise ValueError("kind: daily or bootstrap")
        if not 1 <= churn_days <= 3650 or (k is not None and not 2 <= k <= 20):
            raise ValueError("churn_days: 1 to 3650; k: 2 to 20")
        source, _ = landing.validated(self.spark, self.root, source_version, business_date)
        run_date = (date.fromisoformat(business_date) + timedelta(1)).isoformat()
        value = {
            "kind": kind, "pipeline": pipeline, "run_id": run_id, "run_key": json_hash([pipeline, run_id]), "business_date": business_date, "run_date": run_date, "source_version": source_version, "source_hash": json_hash(source),
            "code": code_hash(), "churn_days": churn_days, "first_date": source["first_date"], "requested_k": k, "requested_model": model_version,
        }
        name = self.run_file(value["run_key"], "context")
        if self.files.exists(name):
            saved = self.files.read_json(name)
            if {x: saved[x] for x in value} != value:
                raise ContractError("the run's inputs changed: start a new run")
            return saved
        value["model"] = self.resolve(run_date, model_version) if kind == "daily" else None
        if value["model"] and k is not None and value["model"]["k"] != k:
            raise ContractError("k isn't that of the model")
        self.write(name, value)
        return value

    def load_context(self, run_key: str) -> dict:
        value = self.files.read_json(self.run_file(run_key, "context"))
        if value["code"] != code_hash():
            raise ContractError("the code changed: start a new run")
        return value

    # ---------------------------------------------------------------------------------- stages

    def finish(self, context: dict, stage: str, outputs: dict[str, str], **more: object) -> dict:
        value = {"stage": stage, "context_hash": json_hash(context), "outputs": outputs, "complete": True, **more}
        self.write(self.run_file(context["run_key"], stage), value)
        return value

    def stage(self, context: dict, stage: str) -> dict:
        """A stage's manifest, if it is complete, of this context, and its outputs have their success markers."""
        value = self.files.read_json(self.run_file(context["run_key"], stage))
        if value["context_hash"] != json_hash(context):
            raise ContractError(f"{stage} ran under another context")
        if not value.get("complete"):
            raise ContractError(f"{stage} is incomplete")
        for path in value["outputs"].values():
            if not self.files.exists(f"{path}/_SUCCESS"):
                raise ContractError(f"{path} is incomplete")
        return value

    def run_stage(self, context: dict, stage: str, work: Callable[[dict, str], tuple[dict, dict]]) -> dict:
        """Runs a stage once; one that is finished is checked and taken as it is."""
        if self.files.exists(self.run_file(context["run_key"], stage)):
            return self.stage(context, stage)
        outputs, more = work(context, self.files.at("runs", context["run_key"], stage))
        return self.finish(context, stage, outputs, **more)

    def run_etl(self, context: dict) -> dict:
        def work(context: dict, place: str) -> tuple[dict, dict]:
            typed, rejected = landing.read_landing(self.spark, self.root, context["source_version"], context["business_date"])
            distinct = clean.deduplicated(typed).cache()
            try:
                kept = clean.daily_policy(distinct)
                paths = {n: f"{place}/{n}" for n in ("curated", "audit_input", "parse_errors")}
                write_once(kept, paths["curated"], "year", "month")
                write_once(distinct, paths["audit_input"])
                write_once(rejected, paths["parse_errors"])
                counts = {"input": typed.count(), "distinct": distinct.count(), "kept": self.spark.read.parquet(paths["curated"]).count(), "rejected": self.spark.read.parquet(paths["parse_errors"]).count()}
                return paths, {"counts": counts}
            finally:
                distinct.unpersist()

        return self.run_stage(context, "etl", work)

    def run_rfm(self, context: dict, config: Config = DEFAULT) -> dict:
        etl = self.stage(context, "etl")

        def work(context: dict, place: str) -> tuple[dict, dict]:
            model = context["model"]
            history = clean.metrics_history(self.spark.read.parquet(etl["outputs"]["curated"]), context["run_date"])
            scored = rfm.scores(rfm.metrics(history, context["run_date"]), config.rfm)
            found = ml.assign(PipelineModel.load(self.verified(model)["path"]), scored, model["version"])
            days = (date.fromisoformat(context["run_date"]) - date.fromisoformat(context["first_date"])).days
            labelled = rfm.labels(found, days, config.rfm)
            paths = {"customers": f"{place}/customers", "cluster_profile": f"{place}/cluster_profile"}
            write_once(labelled, paths["customers"])
            written = self.spark.read.parquet(paths["customers"])
            rfm.require_scored_contract(written, model["k"])
            write_once(rfm.cluster_profile(written), paths["cluster_profile"])
            return paths, {"etl_hash": json_hash(etl), "model": model}

        return self.run_stage(context, "rfm", work)

    def run_audit(self, context: dict, config: Config = DEFAULT) -> dict:
        etl = self.stage(context, "etl")

        def work(context: dict, place: str) -> tuple[dict, dict]:
            rows = self.spark.read.parquet(etl["outputs"]["audit_input"]).select(*COLUMNS)
            paths = {"row_assessments": f"{place}/row_assessments", "order_assessments": f"{place}/order_assessments", "flagged_orders": f"{place}/flagged_orders"}
            write_once(audit.audit(rows, context["run_date"], config), paths["row_assessments"])
            audit.require_audit_contract(self.spark.read.parquet(paths["row_assessments"]), rows, context["run_date"])
            write_once(orders.assess_orders(rows, context["run_date"], config), paths["order_assessments"])
            write_once(self.spark.read.parquet(paths["order_assessments"]).where(F.col("status") == "flagged"), paths["flagged_orders"])
            return paths, {"etl_hash": json_hash(etl)}

        return self.run_stage(context, "audit", work)

    # ---------------------------------------------------------------------------------- publication

    def _agreed(self, context: dict, *stages: str) -> dict:
        found = {s: self.stage(context, s) for s in ("etl", *stages)}
        mark = json_hash(found["etl"])
        if any(found[s]["etl_hash"] != mark for s in stages):
            raise ContractError("the branches read different cleaned data")
        if "rfm" in found and found["rfm"]["model"] != context["model"]:
            raise ContractError("the model isn't that of the context")
        return found

    def publish_branch(self, context: dict, branch: str) -> dict:
        """One branch of a day, whatever the other does; never replaced."""
        value = {"context": context, "stages": self._agreed(context, branch), "branch": branch, "complete": True}
        name = self.files.at("manifests", "published", branch, f"{context['run_date']}.json")
        if self.files.exists(name):
            if self.files.read_json(name) != value:
                raise FileExistsError(name)
            return value
        self.write(name, value)
        return value

    def publish(self, context: dict) -> dict:
        """A day: all stages, of one context and one cleaning."""
        if context["kind"] != "daily":
            raise ContractError("only daily runs are published")
        value = {"context": context, "stages": self._agreed(context, "rfm", "audit"), "complete": True}
        with self.files.lock(f".publish-{context['run_date']}.lock"):
            name = self.run_file(context["run_key"], "completion")
            if not self.files.exists(name):
                self.write(name, value)
            day = self.files.at("manifests", "published", f"{context['run_date']}.json")
            if self.files.exists(day) and self.files.read_json(day) != value:
                raise FileExistsError(day)
            if not self.files.exists(day):
                self.write(day, value)
        return value

    def verify_snapshot(self, run_date: str) -> dict:
        """A published day as a consumer may rely on it."""
        value = self.files.read_json(self.files.at("manifests", "published", f"{run_date}.json"))
        if not value.get("complete") or self._agreed(value["context"], "rfm", "audit") != value["stages"]:
            raise ContractError(f"{run_date} isn't what was published")
        return value

    # ---------------------------------------------------------------------------------- models

    def register(self, path: str, k: int, version: str, **facts: object) -> dict:
        """A model's manifest with the hash of its files."""
        value = {"version": version, "k": k, "path": path, "hash": self.tree_hash(path), **facts}
        self.write(self.files.at("models", version, "manifest.json"), value)
        return value

    def activate(self, version: str, effective_from: str) -> dict:
        self.verified({"version": version})
        with self.files.lock(".registry.lock"):
            names = [n for n in self.files.names(self.files.at("models", "activations")) if n.endswith(".json")]
            value = {"sequence": len(names) + 1, "version": version, "effective_from": date.fromisoformat(effective_from).isoformat()}
            self.write(self.files.at("models", "activations", f"{value['sequence']:06d}.json"), value)
        return value

    def resolve(self, run_date: str, version: str | None = None) -> dict:
        """The model in force at a date: the latest effective, then the last activated; or the one that is asked for."""
        if version is None:
            folder = self.files.at("models", "activations")
            found = [self.files.read_json(f"{folder}/{n}") for n in self.files.names(folder) if n.endswith(".json")]
            found = [a for a in found if a["effective_from"] <= run_date]
            if not found:
                raise LookupError(f"no model in force at {run_date}")
            version = max(found, key=lambda a: (a["effective_from"], a["sequence"]))["version"]
        manifest = self.verified({"version": version})
        return {"version": version, "k": manifest["k"], "hash": manifest["hash"]}

    def verified(self, binding: dict) -> dict:
        manifest = self.files.read_json(self.files.at("models", binding["version"], "manifest.json"))
        if self.tree_hash(manifest["path"]) != manifest["hash"] or binding.get("hash", manifest["hash"]) != manifest["hash"]:
            raise ContractError(f"model {binding['version']} was changed")
        return manifest

    def tree_hash(self, path: str) -> str:
        """Of all files under a path, by name and content."""
        found, todo = {}, [path.rstrip("/")]
        while todo:
            at = todo.pop()
            for s in self.files.fs.listStatus(self.files.path(at)):
                name = f"{at}/{s.getPath().getName()}"
                if s.isDirectory():
                    todo.append(name)
                elif not s.getPath().getName().startswith("."):
                    stream = self.files.fs.open(s.getPath())
                    try:
                        found[name.removeprefix(path.rstrip("/"))] = self.spark._jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)
                    finally:
                        stream.close()
        return json_hash(found)

    def pin(self, context: dict) -> dict:
        """What a run trains on, written once: its cleaning, source and code, and the cutoffs of the splits."""
        etl = self.stage(context, "etl")
        value = {"context_hash": json_hash(context), "etl_hash": json_hash(etl), "source_hash": context["source_hash"], "code": code_hash(), "dates": training_dates(context["run_date"])}
        name = self.run_file(context["run_key"], "training")
        if value["dates"]["train"] <= context["first_date"]:
            value["dates"] = None  # too short a history to hold rows out
        if self.files.exists(name):
            if self.files.read_json(name) != value:
                raise ContractError("what the run trains on changed: start a new run")
            return value
        self.write(name, value)
        return value

    def train(self, context: dict, k: int, version: str, seed: int = 42) -> dict:
        """Fits, saves, checks and registers a model on a run's cleaned data."""
        pinned = self.pin(context)
        etl = self.stage(context, "etl")
        metrics = rfm.metrics(clean.metrics_history(self.spark.read.parquet(etl["outputs"]["curated"]), context["run_date"]), context["run_date"])
        path = self.files.at("models", version, "pipeline")
        ml.save_checked(ml.fit_kmeans(metrics, k, seed), path, metrics)
        return self.register(path, k, version, cutoff=context["run_date"], etl_hash=json_hash(etl), seed=seed, training_hash=json_hash(pinned))

    def daily(self, context: dict, config: Config = DEFAULT) -> dict:
        """All stages of a day and its publication."""
        self.run_etl(context)
        self.run_rfm(context, config)
        self.run_audit(context, config)
        return self.publish(context)


def training_dates(cutoff: str) -> dict[str, str]:
    """Cutoffs of training, validation and test before a refit: 90, 60 and 30 days earlier."""
    day = date.fromisoformat(cutoff)
    return {n: (day - timedelta(d)).isoformat() for n, d in (("train", 90), ("validation", 60), ("test", 30))} | {"refit": cutoff}
