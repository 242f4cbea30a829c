"""Landing area: a source file split by day, committed by a manifest, and validated before it is read."""

from __future__ import annotations

import csv
import uuid
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.operators.audit import multiset_difference
from granary.operators.store import fingerprint
from granary.schema import COLUMNS, ContractError
from granary.sources.readers import DATE_FORMAT, landing_csv
from granary.sources.storage import Files

SCHEMA_VERSION = 2
#: Rows of a file at most, so that its hash is taken of a bounded text.
FILE_ROWS = 1_000_000
UNDATED = "undated"


#: Encodings that Spark reads without being told to take any that Java has.
USUAL = ("iso-8859-1", "us-ascii", "utf-16", "utf-16be", "utf-16le", "utf-32", "utf-8")


def texts(spark: SparkSession, path: str | list[str], encoding: str) -> DataFrame:
    if encoding.lower() not in USUAL:
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    options = {"header": True, "mode": "FAILFAST", "multiLine": True, "escape": '"', "quote": '"', "encoding": encoding, "enforceSchema": False}
    return spark.read.schema(", ".join(f"{c} string" for c in COLUMNS)).options(**options).csv(path)


def days(first: str, last: str) -> list[str]:
    a, b = date.fromisoformat(first), date.fromisoformat(last)
    return [(a + timedelta(n)).isoformat() for n in range((b - a).days + 1)]


def hashes(spark: SparkSession, folders: list[str]) -> dict[str, str]:
    """sha256 of every file in the folders, by folder and file name; a row a file comes to the driver."""
    if not folders:
        return {}
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folders)
    return dict(files.select(F.regexp_extract("path", "([^/]+/[^/]+)$", 1), F.sha2("content", 256)).collect())


def split(spark: SparkSession, source: str, root: str, version: str, encoding: str = "cp1252") -> dict:
    """Writes one UTF-8 CSV folder for each day that the source holds, and one for undated rows, then the manifest.

    All is written beside its place, read back and compared, and renamed at last. The same source again returns the manifest it made;
    another source under the version is an error. Days without rows are in the manifest with none.
    """
    files = Files(spark, root)
    place = files.at("landing", version)
    rows = texts(spark, source, encoding)
    mark = fingerprint(rows)
    if files.exists(f"{place}/manifest.json"):
        old = files.read_json(f"{place}/manifest.json")
        if (old["source"], old["encoding"]) != (mark, encoding):
            raise ContractError("the source changed: choose another version")
        return old
    if files.exists(place):
        raise FileExistsError(f"{place} isn't committed; look at it before another try")
    keyed = rows.withColumn("date", F.coalesce(F.date_format(F.try_to_timestamp("InvoiceDate", F.lit(DATE_FORMAT)), "yyyy-MM-dd"), F.lit(UNDATED)))
    counts = {r.date: r.n for r in keyed.groupBy("date").agg(F.count("*").alias("n")).collect()}  # a row a day
    dated = sorted(set(counts) - {UNDATED})
    if not dated:
        raise ContractError("no row has a date")
    beside = files.at("landing", f".{version}-{uuid.uuid4().hex}")
    spread = keyed.hint("rebalance", "date")  # a day of many rows goes to several tasks
    spread.write.partitionBy("date").options(maxRecordsPerFile=FILE_ROWS, header=True, escape='"', quoteAll=True, encoding="UTF-8", emptyValue="", nullValue="").csv(beside)
    back = texts(spark, [f"{beside}/date={d}" for d in counts], "UTF-8")
    blank = lambda df: df.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in COLUMNS])
    if not multiset_difference(blank(back), blank(rows)).isEmpty():
        raise ContractError("what was written isn't what was read")
    marks = hashes(spark, [f"{beside}/date={d}" for d in counts])

    def entry(day: str) -> dict:
        if day not in counts:
            return {"path": None, "rows": 0}
        files_of = {n: {"bytes": size, "sha256": marks[f"date={day}/{n}"]} for n, size in files.sizes(f"{beside}/date={day}").items()}
        return {"path": f"date={day}", "rows": counts[day], "bytes": sum(f["bytes"] for f in files_of.values()), "files": files_of}

    manifest = {
        "schema_version": SCHEMA_VERSION, "version": version, "source": mark, "encoding": encoding, "first_date": dated[0], "last_date": dated[-1], "rows": sum(counts.values()),
        "partitions": {d: entry(d) for d in days(dated[0], dated[-1])}, "undated": entry(UNDATED), "complete": True,
    }
    files.write_json(f"{beside}/manifest.json", manifest)
    if not files.fs.rename(files.path(beside), files.path(place)):
        raise OSError(f"{place} couldn't be committed")
    return manifest


def validated(spark: SparkSession, root: str, version: str, business_date: str, checksums: bool = False) -> tuple[dict, list[str]]:
    """(manifest, folders to read) up to a day: complete, of this version and schema, the day covered, every file there with its size and header.

    With checksums every file is read and its hash compared too.
    """
    files = Files(spark, root)
    place = files.at("landing", version)
    manifest = files.read_json(f"{place}/manifest.json")
    if not manifest.get("complete") or manifest.get("version") != version:
        raise ContractError("the manifest is incomplete or of another version")
    if manifest.get("schema_version") != SCHEMA_VERSION:
        raise ContractError("unknown landing schema")
    if not manifest["first_date"] <= date.fromisoformat(business_date).isoformat() <= manifest["last_date"]:
        raise ContractError(f"{business_date} is outside of the source")
    wanted = [*days(manifest["first_date"], business_date), UNDATED]
    entries = [manifest["undated"] if d == UNDATED else manifest["partitions"].get(d) for d in wanted]
    if None in entries:
        raise ContractError("a day is missing from the manifest")
    held = {f"{place}/{e['path']}": e["files"] for e in entries if e["path"]}
    for folder, wanted_files in held.items():
        if files.sizes(folder) != {n: f["bytes"] for n, f in wanted_files.items()}:
            raise ContractError(f"{folder}: files are missing, added, or of another size")
        for name in wanted_files:
            if next(csv.reader([files.first_line(f"{folder}/{name}") or ""]), None) != list(COLUMNS):
                raise ContractError(f"{folder}/{name}: another header")
    if checksums:
        found = hashes(spark, list(held))
        changed = [f"{folder}/{n}" for folder, fs in held.items() for n, f in fs.items() if found.get(f"{folder.rsplit('/', 1)[1]}/{n}") != f["sha256"]]
        if changed:
            raise ContractError(f"files were changed: {changed[:5]}")
    return manifest, list(held)


def read_landing(spark: SparkSession, root: str, version: str, business_date: str, checksums: bool = True) -> tuple[DataFrame, DataFrame]:
    """(typed, rejected) of all days up to a business date; typed rows after it are an error."""
    _, folders = validated(spark, root, version, business_date, checksums)
    typed, rejected = landing_csv(spark, folders)
    after = F.lit(business_date).cast("date")
    if not typed.where(F.to_date("InvoiceDate") > after).isEmpty():
        raise ContractError("a landing folder holds later days")
    return typed, rejected
