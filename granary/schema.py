"""Table schemas and exact-type contracts: a type that differs is refused, never cast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

TRANSACTION = T.StructType([
    T.StructField("InvoiceNo", T.StringType()),
    T.StructField("StockCode", T.StringType()),
    T.StructField("Description", T.StringType()),
    T.StructField("Quantity", T.IntegerType()),
    T.StructField("InvoiceDate", T.TimestampType()),
    T.StructField("UnitPrice", T.DoubleType()),
    T.StructField("CustomerID", T.StringType()),
    T.StructField("Country", T.StringType()),
])
COLUMNS = TRANSACTION.fieldNames()
#: What customer metrics need of a transaction.
METRIC_COLUMNS = ("CustomerID", "InvoiceNo", "InvoiceDate", "Quantity", "UnitPrice")
#: Names that the store writes itself.
RESERVED = ("batch_id", "transaction_date", "_customer_bucket")


class ContractError(ValueError):
    """Data that breaks a contract."""


def require_types(df: DataFrame, columns: tuple[str, ...] | list[str] = tuple(COLUMNS)) -> None:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ContractError(f"missing columns: {missing}")
    wrong = {c: df.schema[c].dataType.simpleString() for c in columns if df.schema[c].dataType != TRANSACTION[c].dataType}
    if wrong:
        raise ContractError(f"unexpected types: {wrong}")


def same_columns(a: T.StructType, b: T.StructType) -> bool:
    """Equal names and types in any order."""
    return {f.name: f.dataType for f in a} == {f.name: f.dataType for f in b}
