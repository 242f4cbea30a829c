"""Incremental customer state: pure steps, and a versioned store that takes each batch exactly once."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions.exprs import money
from granary.operators.clean import require_before, require_metrics_contract
from granary.schema import RESERVED, ContractError
from granary.sources.staging import scope, stage

MONEY = "decimal(38,8)"


def canonical(transactions: DataFrame) -> DataFrame:
    """Transactions as the store keeps them: contract checked, distinct, year and month from the date."""
    taken = sorted(set(RESERVED) & set(transactions.columns))
    if taken:
        raise ContractError(f"reserved columns: {taken}")
    require_metrics_contract(transactions)
    return transactions.withColumns({"year": F.year("InvoiceDate"), "month": F.month("InvoiceDate")}).dropDuplicates()


def customer_state(transactions: DataFrame) -> DataFrame:
    """CustomerID, LastPurchaseDate, Frequency, MonetaryTotal (not rounded)."""
    return transactions.groupBy("CustomerID").agg(F.max("InvoiceDate").alias("LastPurchaseDate"), F.count_distinct("InvoiceNo").alias("Frequency"), F.sum(money(F.col("Quantity"), F.col("UnitPrice"))).cast(MONEY).alias("MonetaryTotal"))


def known_invoices(transactions: DataFrame) -> DataFrame:
    return transactions.select("CustomerID", "InvoiceNo").distinct()


def new_invoices(known: DataFrame, delta: DataFrame) -> DataFrame:
    return known_invoices(delta).join(known, ["CustomerID", "InvoiceNo"], "left_anti")


def novel_rows(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows of incoming that aren't stored; nulls equal nulls."""
    same = [incoming[c].eqNullSafe(stored[c]) for c in incoming.columns]
    return incoming.join(stored, same, "left_anti")


def advanced(state: DataFrame, known: DataFrame, delta: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(state, known invoices) after delta, whose rows must be new."""
    # delta once: by invoice first, which the known ones then mark
    invoices = delta.groupBy("CustomerID", "InvoiceNo").agg(F.max("InvoiceDate").alias("last"), F.sum(money(F.col("Quantity"), F.col("UnitPrice"))).alias("money"))
    invoices = invoices.join(known.withColumn("seen", F.lit(True)), ["CustomerID", "InvoiceNo"], "left")
    more = invoices.groupBy("CustomerID").agg(F.max("last").alias("last"), F.sum("money").cast(MONEY).alias("money"), F.count_if(F.col("seen").isNull()).alias("fresh"))
    fresh = invoices.where("seen is null").select("CustomerID", "InvoiceNo")
    both = state.join(more, "CustomerID", "full")
    nothing = F.lit(0)
    after = both.select(
        "CustomerID",
        F.greatest("LastPurchaseDate", "last").alias("LastPurchaseDate"),
        (F.coalesce("Frequency", nothing) + F.coalesce("fresh", nothing)).alias("Frequency"),
        (F.coalesce("MonetaryTotal", nothing.cast(MONEY)) + F.coalesce("money", nothing.cast(MONEY))).cast(MONEY).alias("MonetaryTotal"),
    )
    return after, known.unionByName(fresh)


def metrics_of(state: DataFrame, run_date: str) -> DataFrame:
    """Customer metrics at a cutoff; money is rounded here, once."""
    day = F.lit(run_date).cast("date")
    return state.select("CustomerID", day.alias("run_date"), "LastPurchaseDate", F.date_diff(day, F.to_date("LastPurchaseDate")).alias("Recency"), "Frequency", F.round("MonetaryTotal", 2).alias("Monetary"))


def fingerprint(df: DataFrame) -> dict:
    """Rows, schema and an order-free sum of row hashes: equal for equal multisets. One aggregate, no Python on the executors."""
    columns = sorted(df.columns)
    hashed = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    slices = [F.sum(F.conv(F.substring(hashed, 1 + 12 * i, 12), 16, 10).cast("decimal(20,0)")).cast("string").alias(f"s{i}") for i in range(5)]
    found = df.agg(F.count("*").alias("rows"), *slices).first()
    return {"rows": found.rows, "sums": [found[f"s{i}"] for i in range(5)], "schema": {c: df.schema[c].dataType.simpleString() for c in columns}}


class Store:
    """Customer state in versions. A version is a manifest that names the folders it is made of, written last and never changed.

    Transactions lie by customer bucket and day, state and invoices by bucket. An ingest rewrites the state of the buckets it
    touches in one job, adds the novel transactions, and leaves all else where it lies.
    """

    def __init__(self, spark: SparkSession, root: str):
        from granary.sources.storage import Files

        self.spark, self.files = spark, Files(spark, root)

    # ---------------------------------------------------------------------------------- versions

    def versions(self) -> list[str]:
        return [n.removesuffix(".json") for n in self.files.names(self.files.at("manifests")) if re.fullmatch(r"\d{12}\.json", n)]

    def manifest(self, version: str | None = None, run_date: str | None = None) -> dict:
        """A version, or the newest of a cutoff not after run_date, or the newest."""
        for v in reversed(self.versions()) if version is None else [version]:  # cutoffs never go back: the first that fits is the newest
            found = self.files.read_json(self.files.at("manifests", f"{v}.json"))
            if run_date is None or found["run_date"] <= run_date:
                return found
        raise LookupError("no such version")

    def read(self, table: str, manifest: dict | None = None) -> DataFrame:
        manifest = manifest or self.manifest()
        if table == "transactions":
            return self._transactions(manifest).drop("_customer_bucket")
        return self.spark.read.parquet(*sorted(set(manifest[table].values()))).drop("_customer_bucket")

    def _transactions(self, manifest: dict) -> DataFrame:
        return self.spark.read.option("basePath", self.files.at("transactions")).parquet(*manifest["transactions"]).drop("generation", "transaction_date")

    # ---------------------------------------------------------------------------------- ingest

    def ingest(self, transactions: DataFrame, batch_id: str, run_date: str, initialize: bool = False, buckets: int | None = None) -> dict:
        """Publishes a version with the batch. The same batch again returns the version it made; another under its id is an error.

        Rows that are stored already add nothing. Rows may be of any day before the cutoff, which never goes back.
        """
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_-]{0,127}", batch_id or ""):
            raise ValueError("batch_id: letters, digits, _ and - only")
        if buckets is not None and not 1 <= buckets <= 4096:
            raise ValueError("buckets: 1 to 4096")
        with self.files.lock(), scope(self.spark, []):
            incoming = stage(canonical(transactions), "incoming")
            require_before(incoming, run_date)
            mark = fingerprint(incoming)
            versions = self.versions()
            old = self.manifest(versions[-1]) if versions else None
            if old is None and not initialize:
                raise ValueError("the first ingest must say initialize")
            if old:
                seen = old["batches"].get(batch_id)
                if seen:
                    if (seen["fingerprint"], seen["run_date"]) != (mark, run_date):
                        raise ContractError(f"batch {batch_id} came before with other rows or another cutoff")
                    return self.manifest(seen["version"])
                if initialize:
                    raise ValueError("the store is initialized")
                if run_date < old["run_date"]:
                    raise ContractError("the cutoff goes back")
                if buckets not in (None, old["buckets"]):
                    raise ContractError("the number of buckets can't change")
                if mark["schema"] != old["schema"]:
                    raise ContractError("the columns changed")
            n = old["buckets"] if old else buckets or 64
            version = f"{len(versions) + 1:012d}"
            made = self._write(incoming, old, n, version)
            batches = (old["batches"] if old else {}) | {batch_id: {"fingerprint": mark, "run_date": run_date, "version": version}}
            manifest = made | {"version": version, "run_date": run_date, "buckets": n, "schema": mark["schema"], "batches": batches}
            self.files.fs.mkdirs(self.files.path(self.files.at("manifests")))
            self.files.write_json(self.files.at("manifests", f"{version}.json"), manifest)
            return manifest

    def _write(self, incoming: DataFrame, old: dict | None, n: int, version: str) -> dict:
        name = f"{version}_{uuid.uuid4().hex}"
        generation = self.files.at("generations", name)
        bucket = F.pmod(F.xxhash64("CustomerID"), F.lit(n)).cast("int")
        tagged = incoming.withColumn("_customer_bucket", bucket)
        touched = sorted(r[0] for r in tagged.select("_customer_bucket").distinct().collect())  # at most n
        rows = tagged
        if old:
            stored = self._transactions(old).where(F.col("_customer_bucket").isin(touched)).select(*tagged.columns)
            rows = novel_rows(tagged, stored)
        novel = self.files.at("transactions", f"generation={name}")
        rows.withColumn("transaction_date", F.to_date("InvoiceDate")).repartition("_customer_bucket", "transaction_date").write.partitionBy("_customer_bucket", "transaction_date").mode("errorifexists").parquet(novel)
        delta = self.spark.read.schema(tagged.schema).parquet(novel)
        state, invoices = customer_state(delta), known_invoices(delta)
        if old:
            own = F.pmod(F.xxhash64("CustomerID"), F.lit(n)).isin(touched)
            state, invoices = advanced(self.read("state", old).where(own), self.read("invoices", old).where(own), delta)
        made: dict = {"transactions": [*(old["transactions"] if old else []), *([novel] if not delta.isEmpty() else [])]}
        for name, df in (("state", state), ("invoices", invoices)):
            path = f"{generation}/{name}"
            df.withColumn("_customer_bucket", bucket).repartition("_customer_bucket").write.partitionBy("_customer_bucket").mode("errorifexists").parquet(path)
            held = {x.split("=")[1] for x in self.files.names(path) if x.startswith("_customer_bucket=")}
            made[name] = (old[name] if old else {}) | {b: f"{path}/_customer_bucket={b}" for b in held}
        return made
