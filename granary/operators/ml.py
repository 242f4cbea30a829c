"""Clustering of customers, the choice of its size, and a supervised student of frozen cluster labels."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from datetime import date

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import StandardScaler, StandardScalerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.operators.reports import class_metrics, confusion
from granary.operators.rfm import log_features
from granary.schema import ContractError
from granary.sources.storage import Files

FEATURES = ["Recency_log", "Frequency_log", "Monetary_log"]


def feature_stages() -> list:
    return [VectorAssembler(inputCols=FEATURES, outputCol="raw_features"), StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True)]


def fit_kmeans(metrics: DataFrame, k: int, seed: int = 42) -> PipelineModel:
    """Features and clusters as one model; refused where k isn't backed by the data."""
    if k < 2:
        raise ValueError("k: 2 at least")
    ready = log_features(metrics).cache()
    try:
        different = ready.select(*FEATURES).distinct().count()
        if different < k:
            raise ContractError(f"{different} different customers for {k} clusters")
        model = Pipeline(stages=[*feature_stages(), KMeans(k=k, seed=seed, featuresCol="features", predictionCol="Cluster")]).fit(ready)
        occupied = model.transform(ready).select("Cluster").distinct().count()
        if occupied != k:
            raise ContractError(f"{occupied} of {k} clusters hold customers")
        return model
    finally:
        ready.unpersist()


def assign(model: PipelineModel, metrics: DataFrame, version: str) -> DataFrame:
    """Clusters by a fitted model; nothing is learnt."""
    found = model.transform(log_features(metrics, checked=False))
    return found.drop("raw_features", "features", *FEATURES).withColumn("model_version", F.lit(version))


def sweep(metrics: DataFrame, k_max: int, seed: int = 42) -> DataFrame:
    """k, wssse, silhouette for every k from 2; one scaling for all."""
    ready = log_features(metrics)
    scaled = Pipeline(stages=feature_stages()).fit(ready).transform(ready).select("features").cache()
    try:
        rows = []
        for k in range(2, min(k_max, scaled.count() - 1) + 1):
            model = KMeans(k=k, seed=seed).fit(scaled)
            rows.append((k, float(model.summary.trainingCost), float(ClusteringEvaluator().evaluate(model.transform(scaled)))))
        return metrics.sparkSession.createDataFrame(rows, "k int, wssse double, silhouette double")
    finally:
        scaled.unpersist()


def same_assignments(a: PipelineModel, b: PipelineModel, metrics: DataFrame) -> bool:
    """Whether two models, such as one saved and loaded again, put every customer alike."""
    one, two = (assign(m, metrics, "").select("CustomerID", "Cluster") for m in (a, b))
    return one.join(two.withColumnRenamed("Cluster", "other"), "CustomerID").where("Cluster <> other").isEmpty()


def parameters(model: PipelineModel) -> Iterator[float]:
    """All fitted numbers of a clustering."""
    for part in model.stages:
        if isinstance(part, StandardScalerModel):
            yield from (*part.mean, *part.std)
        elif isinstance(part, KMeansModel):
            for centre in part.clusterCenters():
                yield from centre


def save_checked(model: PipelineModel, path: str, metrics: DataFrame) -> None:
    """Saves a model; one with parameters that aren't finite, or that doesn't come back the same, is an error."""
    if not all(math.isfinite(x) for x in parameters(model)):
        raise ContractError("the model has parameters that aren't finite")
    model.write().save(path)
    if not same_assignments(model, PipelineModel.load(path), metrics):
        raise ContractError(f"{path}: the loaded model differs")


@dataclass(frozen=True)
class Candidate:
    trees: int
    depth: int


def fit_student(labelled: DataFrame, candidate: Candidate, k: int, seed: int = 42) -> PipelineModel:
    """A forest that reproduces Cluster from the metrics; every cluster must be there."""
    if labelled.select("Cluster").distinct().count() != k:
        raise ContractError("not every cluster is in the training rows")
    forest = RandomForestClassifier(labelCol="Cluster", featuresCol="raw_features", predictionCol="predicted", numTrees=candidate.trees, maxDepth=candidate.depth, seed=seed)
    return Pipeline(stages=[feature_stages()[0], forest]).fit(log_features(labelled))


def student_scores(model: PipelineModel, metrics: DataFrame, model_id: str) -> DataFrame:
    """Cluster and confidence by the student."""
    found = model.transform(log_features(metrics.drop("Cluster"), checked=False))
    return found.select(*[c for c in metrics.columns if c != "Cluster"], F.col("predicted").cast("int").alias("Cluster"), F.array_max(vector_to_array("probability")).alias("confidence"), F.lit(model_id).alias("supervised_model_id"))


def cohorts(model: PipelineModel, labelled: DataFrame, seen: DataFrame) -> dict[str, dict]:
    """Macro F1, accuracy and rows of all, seen and new customers."""
    scored = student_scores(model, labelled, "").select("CustomerID", F.col("Cluster").alias("predicted")).join(labelled.select("CustomerID", F.col("Cluster").alias("label")), "CustomerID")
    marked = scored.join(seen.select("CustomerID").distinct().withColumn("__seen", F.lit(True)), "CustomerID", "left").withColumn("cohort", F.when(F.col("__seen"), "seen").otherwise("new"))
    out = {}
    for name in ("all", "seen", "new"):
        own = marked if name == "all" else marked.where(F.col("cohort") == name)
        found = class_metrics(confusion(own, "label", "predicted")).agg(F.avg("f1").alias("f1"), F.sum("hits").alias("hits"), F.sum("support").alias("rows")).first()
        out[name] = {"macro_f1": found.f1 or 0.0, "accuracy": (found.hits or 0) / found.rows if found.rows else 0.0, "rows": int(found.rows or 0)}
    return out


def select_student(train: DataFrame, validation: DataFrame, test: DataFrame, k: int, grid: list[Candidate], minimum: float = 0.8, seed: int = 42) -> tuple[PipelineModel, dict]:
    """Best candidate by macro F1 on new validation customers (then fewer trees, then shallower), gated, tested once, fitted again on all."""
    if validation.join(train, "CustomerID", "left_anti").isEmpty():
        raise ContractError("no new customers to validate on")
    results = [(c, cohorts(fit_student(train, c, k, seed), validation, train)) for c in grid]
    best, found = min(results, key=lambda r: (-r[1]["new"]["macro_f1"], r[0].trees, r[0].depth))
    if found["new"]["macro_f1"] < minimum:
        raise ContractError(f"macro F1 {found['new']['macro_f1']:.4f} is below {minimum}")
    both = train.unionByName(validation).dropDuplicates(["CustomerID"])
    report = {"candidate": asdict(best), "validation": found, "test": cohorts(fit_student(both, best, k, seed), test, both)}
    return fit_student(both.unionByName(test).dropDuplicates(["CustomerID"]), best, k, seed), report


# ---------------------------------------------------------------------------------------------- the student as a bundle


BUNDLE_VERSION = 1
TARGET = "frozen_clusters"
SPLITS = ("train", "validation", "test", "refit")


def bundle_info(student: PipelineModel, candidate: Candidate, k: int, dates: dict[str, str]) -> dict:
    """What a bundle says about its student. dates: cutoffs of training, validation, test and refit."""
    return {"bundle_version": BUNDLE_VERSION, "target": TARGET, "model_id": student.uid, "k": k, "candidate": asdict(candidate), "dates": {n: dates[n] for n in SPLITS}}


def require_info(info: dict, run_date: str | None = None) -> None:
    """A known kind of bundle, its cutoffs in order, and a run after the last of them."""
    if (info.get("bundle_version"), info.get("target")) != (BUNDLE_VERSION, TARGET):
        raise ContractError("unknown bundle: train again")
    days = [date.fromisoformat(info["dates"][n]) for n in SPLITS]
    if any(a >= b for a, b in zip(days, days[1:], strict=False)):
        raise ContractError(f"the cutoffs aren't in order: {info['dates']}")
    if not isinstance(info["k"], int) or info["k"] < 2 or min(info["candidate"]["trees"], info["candidate"]["depth"]) < 1:
        raise ContractError("k, trees or depth out of range")
    if run_date is not None and date.fromisoformat(run_date) <= days[-1]:
        raise ContractError(f"the student has seen {run_date}")


def require_student(model: PipelineModel, info: dict) -> None:
    """The features and the forest that info names, and nothing else."""
    kinds = [type(x) for x in model.stages]
    if kinds != [VectorAssembler, RandomForestClassificationModel]:
        raise ContractError(f"not a student: {[x.__name__ for x in kinds]}")
    features, forest = model.stages
    have = {
        "model_id": model.uid, "inputs": features.getInputCols(), "vector": features.getOutputCol(), "read": forest.getFeaturesCol(), "label": forest.getLabelCol(), "out": forest.getPredictionCol(),
        "classes": forest.numClasses, "width": forest.numFeatures, "trees": forest.getNumTrees, "depth": forest.getMaxDepth(),
    }
    want = {
        "model_id": info["model_id"], "inputs": FEATURES, "vector": "raw_features", "read": "raw_features", "label": "Cluster", "out": "predicted",
        "classes": info["k"], "width": len(FEATURES), "trees": info["candidate"]["trees"], "depth": info["candidate"]["depth"],
    }
    wrong = {n: (have[n], want[n]) for n in want if have[n] != want[n]}
    if wrong:
        raise ContractError(f"the student isn't what its bundle says: {wrong}")


def save_bundle(files: Files, path: str, student: PipelineModel, teacher: PipelineModel, info: dict) -> None:
    """Student, teacher, and last the document that makes them a bundle."""
    require_info(info)
    require_student(student, info)
    student.write().save(f"{path}/student")
    teacher.write().save(f"{path}/teacher")
    require_student(PipelineModel.load(f"{path}/student"), info)
    files.write_json(f"{path}/bundle.json", info)


def load_bundle(files: Files, path: str, run_date: str) -> tuple[PipelineModel, dict]:
    """A complete bundle for a run after its refit."""
    if not files.exists(f"{path}/bundle.json"):
        raise ContractError(f"{path} isn't complete")
    info = files.read_json(f"{path}/bundle.json")
    require_info(info, run_date)
    student = PipelineModel.load(f"{path}/student")
    require_student(student, info)
    return student, info
