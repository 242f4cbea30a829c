"""Run events in the open lineage format, made from stage manifests: what a stage read, what it wrote, and what became of it."""

from __future__ import annotations

import uuid
from datetime import UTC, datetime
from typing import TYPE_CHECKING

from pyspark.sql import SparkSession

if TYPE_CHECKING:
    from granary.operators.publish import Workspace

SCHEMA = "https://openlineage.io/spec/2-0-2/OpenLineage.json#/$defs/RunEvent"
FACET = "https://openlineage.io/spec/facets/1-1-1/SchemaDatasetFacet.json"
PRODUCER = "granary"
STATES = ("START", "COMPLETE", "FAIL")
#: What a stage reads of the stage before it.
READS = {"etl": (), "rfm": ("curated",), "audit": ("audit_input",)}


def run_id(run_key: str, stage: str) -> str:
    """The same for every event of a stage's run."""
    return str(uuid.uuid5(uuid.NAMESPACE_URL, f"{run_key}/{stage}"))


def dataset(spark: SparkSession, namespace: str, path: str) -> dict:
    """A table with its columns, read from its footer."""
    fields = [{"name": f.name, "type": f.dataType.simpleString()} for f in spark.read.parquet(path).schema]
    return {"namespace": namespace, "name": path, "facets": {"schema": {"_producer": PRODUCER, "_schemaURL": FACET, "fields": fields}}}


def event(state: str, run_key: str, stage: str, namespace: str, inputs: list[dict], outputs: list[dict], at: datetime | None = None) -> dict:
    if state not in STATES:
        raise ValueError(f"state: one of {STATES}")
    return {
        "eventType": state, "eventTime": (at or datetime.now(UTC)).isoformat(), "run": {"runId": run_id(run_key, stage)}, "job": {"namespace": namespace, "name": f"{PRODUCER}.{stage}"},
        "inputs": inputs, "outputs": outputs, "producer": PRODUCER, "schemaURL": SCHEMA,
    }


def completed(space: Workspace, context: dict, namespace: str = PRODUCER) -> list[dict]:
    """A completion event for each finished stage of a run; a manifest that doesn't verify is an error."""
    found, etl = [], {}
    for stage, reads in READS.items():
        if not space.files.exists(space.run_file(context["run_key"], stage)):
            continue
        outputs = space.stage(context, stage)["outputs"]
        etl = outputs if stage == "etl" else etl
        inputs = [dataset(space.spark, namespace, etl[r]) for r in reads] or [{"namespace": namespace, "name": space.files.at("landing", context["source_version"])}]
        found.append(event("COMPLETE", context["run_key"], stage, namespace, inputs, [dataset(space.spark, namespace, p) for p in outputs.values()]))
    return found


def publish(space: Workspace, context: dict, namespace: str = PRODUCER) -> list[str]:
    """Writes each event once, as a file under lineage/; those that are there stay."""
    written = []
    for e in completed(space, context, namespace):
        name = space.files.at("lineage", f"{e['run']['runId']}-{e['eventType'].lower()}.json")
        if not space.files.exists(name):
            space.write(name, e)
            written.append(name)
    return written
