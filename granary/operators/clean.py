"""Cleaning: exact duplicates, the two output policies, and history cutoffs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.config import DEFAULT, CleanConfig
from granary.functions.exprs import finite, truth
from granary.schema import METRIC_COLUMNS, ContractError, require_types


def deduplicated(df: DataFrame) -> DataFrame:
    """Rows that differ in any column."""
    return df.dropDuplicates()


def upper_trim(name: str) -> Column:
    return F.upper(F.trim(name))


def charge(config: CleanConfig = DEFAULT.clean) -> Column:
    """A line that is a service rather than goods."""
    return truth(upper_trim("StockCode").isin(*config.service_codes)) | truth(upper_trim("Description").isin(*config.service_descriptions))


def sellable(columns: list[str], config: CleanConfig = DEFAULT.clean) -> Column:
    """Lines that customer metrics may use: complete, not cancelled, positive, goods."""
    complete = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])
    return complete & ~upper_trim("InvoiceNo").startswith("C") & (F.col("Quantity") > 0) & (F.col("UnitPrice") > 0) & ~charge(config)


def metrics_policy(df: DataFrame, config: CleanConfig = DEFAULT.clean) -> DataFrame:
    return df.where(sellable(df.columns, config))


def daily_policy(df: DataFrame, config: CleanConfig = DEFAULT.clean) -> DataFrame:
    """The metrics policy with finite prices and nonblank keys, and with year and month."""
    kept = metrics_policy(df, config).where(finite(F.col("UnitPrice")) & (F.trim("CustomerID") != "") & (F.trim("InvoiceNo") != ""))
    return kept.withColumn("year", F.year("InvoiceDate")).withColumn("month", F.month("InvoiceDate"))


def prepared(df: DataFrame, config: CleanConfig = DEFAULT.clean) -> tuple[DataFrame, DataFrame]:
    """(for customer metrics, for the audit): the audit sees every distinct row."""
    distinct = deduplicated(df)
    return metrics_policy(distinct, config), distinct


def metrics_history(df: DataFrame, run_date: str) -> DataFrame:
    """Rows before the cutoff; rows without a date are dropped."""
    kept = df.where(F.col("InvoiceDate") < F.lit(run_date).cast("timestamp"))
    if {"year", "month"} <= set(df.columns):  # prunes partitions
        year, month = int(run_date[:4]), int(run_date[5:7])
        kept = kept.where((F.col("year") < year) | ((F.col("year") == year) & (F.col("month") <= month)))
    return kept


def audit_history(df: DataFrame, run_date: str) -> DataFrame:
    """Rows before the cutoff and rows without a date."""
    return df.where(F.col("InvoiceDate").isNull() | (F.col("InvoiceDate") < F.lit(run_date).cast("timestamp")))


def require_before(df: DataFrame, run_date: str) -> None:
    if not df.where(F.col("InvoiceDate") >= F.lit(run_date).cast("timestamp")).isEmpty():
        raise ContractError(f"transactions on or after {run_date}")


def require_metrics_contract(df: DataFrame) -> None:
    """Exact types, and every row complete, nonblank, positive and finite."""
    require_types(df, METRIC_COLUMNS)
    bad = (
        F.col("InvoiceDate").isNull()
        | ~truth(F.trim("CustomerID") != "")
        | ~truth(F.trim("InvoiceNo") != "")
        | ~truth(F.col("Quantity") > 0)
        | ~finite(F.col("UnitPrice"))
        | ~truth(F.col("UnitPrice") > 0)
    )
    if not df.where(bad).isEmpty():
        raise ContractError("transactions break the contract of customer metrics")
