"""Queries of exploration over classified rows, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions.exprs import normalized
from granary.operators import clean, exploration
from granary.plans import query, sql
from granary.plans.retail import num, numbers, raw, typed
from granary.plans.sql import dec
from granary.schema import COLUMNS

COHORT = "CASE WHEN k_customer IS NULL THEN 'without_id' ELSE 'with_id' END AS cohort"
SHARES = (0.01, 0.25, 0.5, 0.75, 0.95, 0.99, 0.995)


def _share(condition: str) -> str:
    return dec(f"100.0 * avg(CAST(coalesce({condition}, false) AS INT))")


@query("cohort_profile", f"""WITH {sql.typed()} SELECT {COHORT}, count(*) AS lines, count(DISTINCT InvoiceNo) AS invoices, {_share("cancel")} AS cancel_pct, {_share("Quantity < 0")} AS negative_quantity_pct, {_share("UnitPrice = 0")} AS zero_price_pct, {_share("UnitPrice < 0")} AS negative_price_pct,
  {dec("coalesce(sum(CAST(line_value AS DECIMAL(28,6))), 0)", 2)} AS signed_value, {dec("coalesce(sum(CAST(CASE WHEN Quantity > 0 AND UnitPrice > 0 THEN line_value END AS DECIMAL(28,6))), 0)", 2)} AS positive_value FROM typed GROUP BY ALL""")
def cohort_profile(spark: SparkSession, d: str) -> DataFrame:
    found = numbers(exploration.cohort_profile(typed(spark, d)), "cancel_pct", "negative_quantity_pct", "zero_price_pct", "negative_price_pct")
    return found.withColumns({c: num(c, 2) for c in ("signed_value", "positive_value")})


@query("cohort_missing", f"WITH {sql.typed()} " + " UNION ALL ".join(f"SELECT {COHORT}, '{c}' AS name, {_share(f'{c} IS NULL')} AS missing_pct FROM typed GROUP BY ALL" for c in COLUMNS))
def cohort_missing(spark: SparkSession, d: str) -> DataFrame:
    return numbers(exploration.cohort_missing(typed(spark, d)), "missing_pct")


@query("cohort_quantiles", f"WITH {sql.typed()}, m AS ({' UNION ALL '.join(f'SELECT {COHORT}, {chr(39)}{m}{chr(39)} AS measure, CAST({m} AS DOUBLE) AS v FROM typed' for m in exploration.MEASURES)}) SELECT cohort, measure, count(v) AS n, {', '.join(f'{dec(f"quantile_cont(v, {q})", 3)} AS q{round(1000 * q)}' for q in SHARES)} FROM m GROUP BY ALL")
def cohort_quantiles(spark: SparkSession, d: str) -> DataFrame:
    found = exploration.cohort_quantiles(typed(spark, d), SHARES)
    return found.withColumns({f"q{round(1000 * q)}": num(f"q{round(1000 * q)}", 3) for q in SHARES})


FENCED = ", ".join(f"q_{m} AS (SELECT k_stock, count({m}) AS n, quantile_cont(CAST({m} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({m} AS DOUBLE), 0.75) AS q3 FROM typed WHERE sale_shape AND NOT service AND NOT special GROUP BY k_stock HAVING count({m}) >= 30)" for m in exploration.MEASURES)
POINTS = {
    "cancel_not_negative": ("Quantity IS NOT NULL", "cancel AND Quantity >= 0"), "negative_without_cancel": ("Quantity IS NOT NULL", "NOT cancel AND Quantity < 0"), "negative_price": ("UnitPrice IS NOT NULL", "UnitPrice < 0"),
    "zero_in_paid_invoice": ("UnitPrice IS NOT NULL", "UnitPrice = 0 AND positive_price_lines > 0"), "all_zero_invoice": ("true", "zero_price_lines = invoice_lines"), "several_customers": ("true", "customer_count > 1"),
}


def _rates() -> str:
    one = lambda rule, source, eligible, flagged: f"SELECT '{rule}' AS rule, {COHORT}, count(*) AS lines, count(*) FILTER ({eligible}) AS eligible, count(*) FILTER (({eligible}) AND {flagged}) AS flagged FROM {source} GROUP BY ALL"
    parts = [one(r, "typed", *p) for r, p in POINTS.items()]
    for m in exploration.MEASURES:
        for f in exploration.FACTORS:
            parts.append(one(f"{m}_iqr_{f:g}", f"typed LEFT JOIN q_{m} q USING (k_stock)", f"sale_shape AND NOT service AND NOT special AND {m} IS NOT NULL AND q3 > q1", f"{m} > q3 + {f} * (q3 - q1)"))
    return f"WITH {sql.typed('type')}, {FENCED}, r AS ({' UNION ALL '.join(parts)}) SELECT *, {dec('100.0 * flagged / lines')} AS pct_of_lines, {dec('CASE WHEN eligible > 0 THEN 100.0 * flagged / eligible END')} AS pct_of_eligible FROM r"


@query("candidate_rates", _rates())
def candidate_rates(spark: SparkSession, d: str) -> DataFrame:
    return numbers(exploration.candidate_rates(typed(spark, d, "type")), "pct_of_lines", "pct_of_eligible")


NO_PURCHASE = f"WITH {sql.typed('type')}, c AS (SELECT t.* FROM typed t WHERE record_type = 'cancellation' AND k_customer IS NOT NULL AND NOT EXISTS (SELECT 1 FROM typed s WHERE s.record_type = 'sale' AND s.k_customer = t.k_customer AND s.k_stock = t.k_stock))"


@query("evidence_no_purchase", f"{NO_PURCHASE} SELECT count(*) AS no_purchase_lines, {dec('100.0 * avg(CAST(special AS INT))')} AS special_pct, count(*) FILTER (k_customer NOT IN (SELECT k_customer FROM typed WHERE record_type = 'sale' AND k_customer IS NOT NULL)) AS lines_of_non_buyers FROM c")
def evidence_no_purchase(spark: SparkSession, d: str) -> DataFrame:
    return numbers(exploration.no_purchase_summary(typed(spark, d, "type")), "special_pct")


@query("evidence_no_purchase_descriptions", f'{NO_PURCHASE} SELECT Description, count(*) AS lines FROM c WHERE Description IS NOT NULL GROUP BY Description ORDER BY lines DESC, Description LIMIT 8')
def evidence_no_purchase_descriptions(spark: SparkSession, d: str) -> DataFrame:
    return exploration.no_purchase_descriptions(typed(spark, d, "type"))


OTHERS = [c for c in COLUMNS if c != "Description"]


@query("description_pairs", f"WITH {sql.retail()}, {sql.RAW}, d AS (SELECT DISTINCT * FROM raw), u AS (SELECT {', '.join(OTHERS)}, any_value(Description) AS before FROM d GROUP BY ALL HAVING count(*) = 1) SELECT InvoiceNo, StockCode, before, regexp_replace(upper(trim(before)), '\\s+', ' ', 'g') AS after FROM u WHERE before <> regexp_replace(upper(trim(before)), '\\s+', ' ', 'g')")
def description_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Unique rows before and after their descriptions are normalised, one to one on the other seven columns, where they differ."""
    rows = exploration.unique_rows(clean.deduplicated(raw(spark, d)), OTHERS)
    found = exploration.one_to_one(rows, rows.withColumn("Description", normalized(F.col("Description"), True)), OTHERS)
    return found.select("InvoiceNo", "StockCode", F.col("a.Description").alias("before"), F.col("b.Description").alias("after")).where("before <> after")
