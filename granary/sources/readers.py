"""Typed and quarantining CSV scans, Parquet scans, and the retail view over the star-schema tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.schema import COLUMNS, TRANSACTION

DATE_FORMAT = "M/d/yyyy H:mm"
#: Texts of a landing file that stand for a missing value.
MISSING = ("", "NaN")
TYPED = {"InvoiceDate": "timestamp", "Quantity": "int", "UnitPrice": "double"}


def typed_csv(spark: SparkSession, path: str | Sequence[str], encoding: str = "UTF-8") -> DataFrame:
    """Transactions with a header; NaN and cells that don't parse are null."""
    return (
        spark.read.schema(TRANSACTION)
        .options(header=True, timestampFormat=DATE_FORMAT, nullValue="NaN", mode="PERMISSIVE", encoding=encoding)
        .csv(path if isinstance(path, str) else list(path))
    )


def parsed(raw: DataFrame) -> DataFrame:
    """All-text transactions to raw_<column> beside typed <column>, in one projection."""
    present = {c: F.when(~F.col(c).isin(*MISSING), F.col(c)) for c in COLUMNS}
    typed = present | {
        "InvoiceDate": F.try_to_timestamp(present["InvoiceDate"], F.lit(DATE_FORMAT)),
        "Quantity": present["Quantity"].try_cast("int"),
        "UnitPrice": present["UnitPrice"].try_cast("double"),
    }
    return raw.select(*[F.col(c).alias(f"raw_{c}") for c in COLUMNS], *[typed[c].alias(c) for c in COLUMNS])


def quarantine(both: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(typed, rejected) of parsed(): rejected rows held a value that didn't parse, and stay in typed with a null."""
    lost = [F.col(f"raw_{c}").isNotNull() & ~F.col(f"raw_{c}").isin(*MISSING) & F.col(c).isNull() for c in TYPED]
    bad = lost[0] | lost[1] | lost[2]
    return both.select(*COLUMNS), both.where(bad)


def landing_csv(spark: SparkSession, paths: str | Sequence[str], encoding: str = "UTF-8") -> tuple[DataFrame, DataFrame]:
    """(typed, rejected) of landing files: text columns, quoted newlines, malformed files refused."""
    raw = (
        spark.read.schema(", ".join(f"{c} string" for c in COLUMNS))
        .options(header=True, mode="FAILFAST", multiLine=True, escape='"', encoding=encoding)
        .csv(paths if isinstance(paths, str) else list(paths))
    )
    return quarantine(parsed(raw))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def paths(spark: SparkSession, base: str, some: Sequence[str]) -> DataFrame:
    """Several directories under one root, with the partition columns that the root implies."""
    return spark.read.option("basePath", base).parquet(*some)


def json_record(spark: SparkSession, path: str) -> str:
    """A text source that must hold exactly one record."""
    rows = spark.read.text(path).take(2)
    if len(rows) != 1:
        raise ValueError(f"{path}: expected one record")
    return rows[0][0]


def retail_view(spark: SparkSession, sf_dir: str, stock: str = "part") -> DataFrame:
    """The star schema as transactions, with slices of every irregularity that the audit looks for.

    Prices are whole even cents, so that sums and medians are exact. stock: "part" for a code of each part; "type" for a code of each part type, which customers buy often.
    """
    lines, orders, parts, customers, nations = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "part", "customer", "nation"))
    # orders meet their customers before their lines, which are many more
    placed = orders.join(customers, orders.o_custkey == customers.c_custkey).join(nations, customers.c_nationkey == nations.n_nationkey)
    joined = lines.join(parts, lines.l_partkey == parts.p_partkey).join(placed, lines.l_orderkey == placed.o_orderkey)
    o, p, n, c = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_linenumber"), F.col("o_custkey")
    returned = (F.col("l_returnflag") == "R") & (n == 1)
    code = F.concat(F.lit("P"), p.cast("string")) if stock == "part" else F.concat(F.lit("T1 "), F.col("p_type"))
    return joined.select(
        F.when(returned, F.concat(F.lit("C"), o.cast("string"))).when(o % 211 == 5, F.concat(F.lit("A"), o.cast("string"))).otherwise(o.cast("string")).alias("InvoiceNo"),
        F.when((7 * o + 13 * n + p) % 53 == 1, "POST").when((c % 7 == 0) & (o % 3 == 0) & (n == 2), "DOT").otherwise(code).alias("StockCode"),
        F.when((o + p) % 41 == 3, None).when((o + p) % 83 == 7, "wrongly coded  barcode").when((o + p) % 89 == 11, "damaged stock found").otherwise(F.upper("p_name")).alias("Description"),
        F.when((13 * o + n + p) % 991 == 3, None).when(returned, -F.col("l_quantity")).when((3 * o + p) % 499 == 7, 40 * F.col("l_quantity")).when((5 * o + p) % 307 == 2, -F.col("l_quantity")).otherwise(F.col("l_quantity")).cast("int").alias("Quantity"),
        F.when((o + 2 * n) % 977 == 1, F.col("o_orderdate") + F.expr("interval 1 day")).otherwise(F.col("o_orderdate")).cast("timestamp").alias("InvoiceDate"),
        F.when(((11 * o + p) % 61 == 4) | ((3 * c + o) % 89 == 0), 0.0).when((17 * o + p) % 401 == 9, -1.5).otherwise(F.floor(F.col("l_extendedprice") * 50 / F.col("l_quantity")).cast("double") / 50).alias("UnitPrice"),
        F.when(c % 7 == 0, None).when((o + n) % 151 == 0, F.concat(c.cast("string"), F.lit("X"))).otherwise(c.cast("string")).alias("CustomerID"),
        F.when((o + 3 * n + p) % 997 == 5, None).otherwise(F.col("n_name")).alias("Country"),
    )
