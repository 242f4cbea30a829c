"""Exploration over classified rows: rows with and without a customer, point rules and fences for candidates, returns without a purchase, pairs of unique rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.exprs import truth
from granary.operators.ranges import quantiles_of_few
from granary.operators.reports import returns_without_purchase
from granary.schema import COLUMNS, ContractError

MEASURES = ("Quantity", "UnitPrice", "line_value")
FACTORS = (1.5, 3.0)
#: Point rules: where they apply, and what they look for there.
POINT_RULES = {
    "cancel_not_negative": ("k_invoice is not null and Quantity is not null", "cancel and Quantity >= 0"),
    "negative_without_cancel": ("k_invoice is not null and Quantity is not null", "not cancel and Quantity < 0"),
    "negative_price": ("priced", "UnitPrice < 0"),
    "zero_in_paid_invoice": ("k_invoice is not null and priced", "UnitPrice = 0 and positive_price_lines > 0"),
    "all_zero_invoice": ("k_invoice is not null and priced_lines = invoice_lines", "zero_price_lines = invoice_lines"),
    "several_customers": ("k_invoice is not null", "customer_count > 1"),
}
#: Lines whose product has a usual quantity, price and value.
COMPARABLE = "sale_shape and not service and not special and k_stock is not null"


def cohort() -> Column:
    return F.when(F.col("k_customer").isNull(), "without_id").otherwise("with_id")


def cohort_profile(rows: DataFrame) -> DataFrame:
    """Size, shares (of the cohort's lines) and worth of the lines with and without a customer."""
    share = lambda condition: 100 * F.avg(truth(F.expr(condition)).cast("int"))
    worth = lambda condition: F.coalesce(F.sum(F.when(F.expr(condition), F.col("line_value")).cast("decimal(28,6)")), F.lit(0))
    return rows.groupBy(cohort().alias("cohort")).agg(
        F.count("*").alias("lines"), F.count_distinct("InvoiceNo").alias("invoices"), share("cancel").alias("cancel_pct"), share("Quantity < 0").alias("negative_quantity_pct"), share("UnitPrice = 0").alias("zero_price_pct"),
        share("UnitPrice < 0").alias("negative_price_pct"), worth("line_value is not null").alias("signed_value"), worth("Quantity > 0 and UnitPrice > 0").alias("positive_value"),
    )


def cohort_missing(rows: DataFrame) -> DataFrame:
    """cohort, name, missing_pct: the share of blank values of every column."""
    key = {"InvoiceNo": "k_invoice", "StockCode": "k_stock", "CustomerID": "k_customer", "Description": "k_description", "Country": "k_country"}
    shares = rows.groupBy(cohort().alias("cohort")).agg(*[(100 * F.avg(F.col(key.get(c, c)).isNull().cast("int"))).alias(c) for c in COLUMNS])
    return shares.select("cohort", F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("missing_pct")) for c in COLUMNS])).alias("c")).select("cohort", "c.*")


def cohort_quantiles(rows: DataFrame, shares: Sequence[float] = (0.01, 0.25, 0.5, 0.75, 0.95, 0.99, 0.995)) -> DataFrame:
    """cohort, measure, n and exact quantiles. Values are counted, then ranked in ranges: two cohorts would else be two tasks."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in MEASURES]))
    long = rows.select(cohort().alias("cohort"), each.alias("m")).select("cohort", "m.*").where("value is not null and not isnan(value)")
    return quantiles_of_few(long, ["cohort", "measure"], F.col("value"), shares)


def stock_quartiles(rows: DataFrame) -> DataFrame:
    """k_stock, and for each measure a struct (n, q1, q3) over comparable lines, in one pass."""
    quartiles = [F.percentile(F.col(m).cast("double"), F.array(F.lit(0.25), F.lit(0.75))).alias(f"{m}_q") for m in MEASURES]
    found = rows.where(COMPARABLE).groupBy("k_stock").agg(*[F.count(m).alias(f"{m}_n") for m in MEASURES], *quartiles)
    return found.select("k_stock", *[F.struct(F.col(f"{m}_n").alias("n"), F.col(f"{m}_q")[0].alias("q1"), F.col(f"{m}_q")[1].alias("q3")).alias(f"{m}_fence") for m in MEASURES])


def candidate_flags(rows: DataFrame, least: int = 30) -> DataFrame:
    """rows with candidates: an array of (rule, eligible, flagged), six point rules and an upper fence for each measure and factor.

    A fence holds where the line is comparable and its stock has enough lines and a spread.
    """
    known = rows.join(stock_quartiles(rows), "k_stock", "left")
    found = [(name, F.expr(applies), F.expr(wanted)) for name, (applies, wanted) in POINT_RULES.items()]
    for m in MEASURES:
        fence, v = F.col(f"{m}_fence"), F.col(m).cast("double")
        eligible = F.expr(COMPARABLE) & v.isNotNull() & (fence["n"] >= least) & (fence["q3"] > fence["q1"])
        found += [(f"{m}_iqr_{f:g}", eligible, v > fence["q3"] + f * (fence["q3"] - fence["q1"])) for f in FACTORS]
    marks = [F.struct(F.lit(n).alias("rule"), truth(a).alias("eligible"), truth(a & w).alias("flagged")) for n, a, w in found]
    return known.withColumn("candidates", F.array(*marks)).drop(*[f"{m}_fence" for m in MEASURES])


def candidate_rates(rows: DataFrame, least: int = 30) -> DataFrame:
    """rule, cohort, lines, eligible, flagged, and the share of all and of eligible lines that are flagged."""
    each = candidate_flags(rows, least).select(cohort().alias("cohort"), F.explode("candidates").alias("c"))
    counts = each.groupBy("c.rule", "cohort").agg(F.count("*").alias("lines"), F.count_if("c.eligible").alias("eligible"), F.count_if("c.flagged").alias("flagged"))
    return counts.withColumns({"pct_of_lines": 100 * F.col("flagged") / F.col("lines"), "pct_of_eligible": F.when(F.col("eligible") > 0, 100 * F.col("flagged") / F.col("eligible"))})


# ---------------------------------------------------------------------------------------------- returns without a purchase


def no_purchase_summary(rows: DataFrame) -> DataFrame:
    """Cancelled lines of stock that their customer never bought: how many, how many of special codes, how many of customers who bought nothing."""
    buyers = rows.where("record_type = 'sale' and k_customer is not null").select("k_customer").distinct().withColumn("buys", F.lit(True))
    own = returns_without_purchase(rows).where("no_purchase").join(buyers, "k_customer", "left")
    return own.agg(F.count("*").alias("no_purchase_lines"), (100 * F.avg(F.col("special").cast("int"))).alias("special_pct"), F.count_if(F.col("buys").isNull()).alias("lines_of_non_buyers"))


def no_purchase_descriptions(rows: DataFrame, top: int = 8) -> DataFrame:
    """The descriptions that such lines bear most often; equal counts in the order of the text."""
    named = returns_without_purchase(rows).where("no_purchase and Description is not null")
    return named.groupBy("Description").agg(F.count("*").alias("lines")).orderBy(F.desc("lines"), "Description").limit(top)


# ---------------------------------------------------------------------------------------------- pairs


def unique_rows(df: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key (nulls are equal) no other row has."""
    rest = [c for c in df.columns if c not in on]
    found = df.groupBy(*on).agg(F.count("*").alias("__n"), F.first(F.struct(F.lit(0).alias("__0"), *rest)).alias("__rest"))
    return found.where("__n = 1").select(*on, *[F.col("__rest")[c].alias(c) for c in rest])


def one_to_one(a: DataFrame, b: DataFrame, on: Sequence[str], checked: bool = True) -> DataFrame:
    """on, a, b: rows of a and b with the same key (nulls are equal) as structs of their other columns; a repeated key is an error.

    One shuffle: both sides are stacked and grouped, so null keys meet and no join can fan out.
    """
    rest = lambda df: F.struct(F.lit(0).alias("__0"), *[c for c in df.columns if c not in on])
    left, right = a.select(*on, rest(a).alias("a")), b.select(*on, rest(b).alias("b"))
    stacked = left.unionByName(right, allowMissingColumns=True)
    found = stacked.groupBy(*on).agg(F.count("a").alias("__a"), F.count("b").alias("__b"), F.first("a", ignorenulls=True).alias("a"), F.first("b", ignorenulls=True).alias("b"))
    if checked and not found.where("__a > 1 or __b > 1").isEmpty():
        raise ContractError("the key isn't unique on both sides")
    return found.where("__a = 1 and __b = 1").select(*on, F.col("a").dropFields("__0").alias("a"), F.col("b").dropFields("__0").alias("b"))
