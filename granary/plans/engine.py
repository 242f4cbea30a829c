"""Queries over what SQL has no words for (models, the store on disk), and event windows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary import streaming
from granary.operators import ml, rfm, store
from granary.plans import query, sql
from granary.plans.retail import STATE, STATE_OUT, cleaned, customers, num, state_columns
from granary.plans.sql import RUN_DATE, dec
from granary.sources.readers import table
from granary.sources.staging import shared_dir, stage


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}"


@query("kmeans_assign")
def kmeans_assign(spark: SparkSession, d: str) -> DataFrame:
    metrics = customers(spark, d)
    return ml.assign(ml.fit_kmeans(metrics, 3), metrics, "k3").select("CustomerID", "Cluster", "model_version")


@query("k_sweep")
def k_sweep(spark: SparkSession, d: str) -> DataFrame:
    return ml.sweep(rfm.metrics(cleaned(spark, d), RUN_DATE), 4)


@query("student_scores")
def student_scores(spark: SparkSession, d: str) -> DataFrame:
    metrics = stage(rfm.metrics(cleaned(spark, d), RUN_DATE), "rfm")  # clusters and forest look at them many times
    labelled = ml.assign(ml.fit_kmeans(metrics, 2), metrics, "k2").drop("model_version")
    return ml.student_scores(ml.fit_student(labelled, ml.Candidate(20, 5), 2), metrics, "student").select("CustomerID", "Cluster", "confidence")


@query("store_two_batches", f"WITH {sql.CUSTOMERS} {STATE_OUT} ({STATE.format('')})")
def store_two_batches(spark: SparkSession, d: str) -> DataFrame:
    """The store's state after two overlapping batches and a replay."""
    every = stage(cleaned(spark, d), "cleaned")
    kept = store.Store(spark, _folder(spark))
    first, second = every.where(F.col("InvoiceDate") < "1999-01-01"), every.where(F.col("InvoiceDate") >= "1998-06-01")
    kept.ingest(first, "first", "1999-01-01", initialize=True, buckets=8)
    kept.ingest(second, "second", RUN_DATE)
    kept.ingest(second, "second", RUN_DATE)
    return state_columns(kept.read("state"))


@query("store_time_travel", f"WITH {sql.CUSTOMERS} {STATE_OUT} ({STATE.format(chr(39).join(['WHERE InvoiceDate < TIMESTAMP ', '1999-01-01', '']))})")
def store_time_travel(spark: SparkSession, d: str) -> DataFrame:
    """The store's state as of an earlier cutoff, after a later batch."""
    every = stage(cleaned(spark, d), "cleaned")
    kept = store.Store(spark, _folder(spark))
    kept.ingest(every.where(F.col("InvoiceDate") < "1999-01-01"), "first", "1999-01-01", initialize=True, buckets=2)
    kept.ingest(every.where(F.col("InvoiceDate") >= "1999-01-01"), "second", RUN_DATE)
    return state_columns(kept.read("state", kept.manifest(run_date="2000-01-01")))


@query("event_windows", f"SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS events, {dec('sum(CAST(value AS DECIMAL(18,6)))', 2)} AS value FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, d: str) -> DataFrame:
    found = streaming.windowed(table(spark, d, "events"), "ts", "1 hour", "event_type")
    return found.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "events", num("value", 2).alias("value"))


@query("event_sessions", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS events FROM s GROUP BY user_id, session""")
def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    found = streaming.sessions(table(spark, d, "events"), "ts", "30 minutes", "user_id")
    return found.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "events")
