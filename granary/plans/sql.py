"""SQL twins of the shared building blocks, in the dialect of the engine that checks the results."""

from __future__ import annotations

#: Exclusive cutoff of the registered queries: after the last order.
RUN_DATE = "2001-09-01"


def retail(stock: str = "part") -> str:
    code = "'P' || p" if stock == "part" else "'T1 ' || p_type"
    return f"""joined AS (
  SELECT l_orderkey AS o, l_partkey AS p, l_linenumber AS n, o_custkey AS c, l_returnflag = 'R' AND l_linenumber = 1 AS back, l_quantity, l_extendedprice, p_name, p_type, o_orderdate, n_name
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
), retail AS (
  SELECT CASE WHEN back THEN 'C' || o WHEN o % 211 = 5 THEN 'A' || o ELSE CAST(o AS VARCHAR) END AS InvoiceNo,
    CASE WHEN (7 * o + 13 * n + p) % 53 = 1 THEN 'POST' WHEN c % 7 = 0 AND o % 3 = 0 AND n = 2 THEN 'DOT' ELSE {code} END AS StockCode,
    CASE WHEN (o + p) % 41 = 3 THEN NULL WHEN (o + p) % 83 = 7 THEN 'wrongly coded  barcode' WHEN (o + p) % 89 = 11 THEN 'damaged stock found' ELSE upper(p_name) END AS Description,
    CAST(CASE WHEN (13 * o + n + p) % 991 = 3 THEN NULL WHEN back THEN -l_quantity WHEN (3 * o + p) % 499 = 7 THEN 40 * l_quantity WHEN (5 * o + p) % 307 = 2 THEN -l_quantity ELSE l_quantity END AS INT) AS Quantity,
    CASE WHEN (o + 2 * n) % 977 = 1 THEN o_orderdate + INTERVAL 1 DAY ELSE o_orderdate END AS InvoiceDate,
    CASE WHEN (11 * o + p) % 61 = 4 OR (3 * c + o) % 89 = 0 THEN 0.0 WHEN (17 * o + p) % 401 = 9 THEN -1.5 ELSE floor(l_extendedprice * 50 / l_quantity) / 50 END::DOUBLE AS UnitPrice,
    CASE WHEN c % 7 = 0 THEN NULL WHEN (o + n) % 151 = 0 THEN c || 'X' ELSE CAST(c AS VARCHAR) END AS CustomerID,
    CASE WHEN (o + 3 * n + p) % 997 = 5 THEN NULL ELSE n_name END AS Country
  FROM joined
)"""


RAW = "raw AS (SELECT * FROM retail UNION ALL SELECT * FROM retail WHERE Quantity % 5 = 0)"
CLEAN = """clean AS (
  SELECT DISTINCT * FROM raw WHERE InvoiceNo IS NOT NULL AND StockCode IS NOT NULL AND Description IS NOT NULL AND Quantity IS NOT NULL AND InvoiceDate IS NOT NULL
    AND UnitPrice IS NOT NULL AND CustomerID IS NOT NULL AND Country IS NOT NULL AND upper(trim(InvoiceNo)) NOT LIKE 'C%' AND Quantity > 0 AND UnitPrice > 0
    AND upper(trim(StockCode)) NOT IN ('POST', 'M', 'DOT', 'BANK CHARGES', 'C2', 'PADS') AND upper(trim(Description)) NOT IN ('PACKING CHARGE', 'NEXT DAY CARRIAGE')
)"""
RFM = f"""rfm AS (
  SELECT CustomerID, max(InvoiceDate) AS LastPurchaseDate, date_diff('day', CAST(max(InvoiceDate) AS DATE), DATE '{RUN_DATE}') AS Recency, count(DISTINCT InvoiceNo) AS Frequency,
    round(sum(CAST(Quantity AS DECIMAL(18,4)) * CAST(round(CAST(UnitPrice AS DECIMAL(18,6)), 4) AS DECIMAL(18,4))), 2) AS Monetary
  FROM clean GROUP BY CustomerID
)"""


def _score(rank: str) -> str:
    return f"CASE WHEN {rank} < 0.2 THEN 1 WHEN {rank} < 0.4 THEN 2 WHEN {rank} < 0.6 THEN 3 WHEN {rank} < 0.8 THEN 4 ELSE 5 END"


SCORED = f"""ranked AS (
  SELECT *, percent_rank() OVER (ORDER BY Recency DESC) AS r, percent_rank() OVER (ORDER BY Frequency) AS f, percent_rank() OVER (ORDER BY Monetary) AS m FROM rfm
), scored AS (
  SELECT *, {_score("r")} AS R_score, {_score("f")} AS F_score, {_score("m")} AS M_score FROM ranked
)"""
LABELLED = """labelled AS (
  SELECT *, M_score >= 4 AS is_high_value, Recency >= 90 AS is_inactive,
    CASE WHEN Recency >= 90 THEN 'inactivity_proxy' ELSE 'not_flagged' END AS churn_assessment_status,
    CASE WHEN M_score >= 4 AND Recency >= 90 THEN 'high_value_inactive' WHEN M_score >= 4 AND F_score >= 4 AND R_score >= 4 THEN 'high_value_active'
      WHEN Recency >= 90 THEN 'inactive' WHEN R_score >= 4 AND F_score <= 2 THEN 'recent_low_frequency' ELSE 'regular' END AS segment
  FROM scored
)"""
CUSTOMERS = ", ".join([retail(), RAW, CLEAN, RFM, SCORED, LABELLED])

BASE = """base AS (
  SELECT *, InvoiceNo IS NOT NULL AND NOT cancel AND coalesce(Quantity > 0, false) AND coalesce(UnitPrice > 0, false) AND coalesce(line_value > 0, false) AS sale_shape
  FROM (
    SELECT *, upper(trim(InvoiceNo)) AS k_invoice, upper(trim(StockCode)) AS k_stock, upper(trim(CustomerID)) AS k_customer, upper(trim(Country)) AS k_country,
      regexp_replace(upper(trim(Description)), '\\s+', ' ', 'g') AS k_description, Quantity * UnitPrice AS line_value,
      coalesce(starts_with(InvoiceNo, 'C'), false) AS cancel, coalesce(StockCode IN ('POST', 'M', 'DOT', 'BANK CHARGES', 'C2', 'PADS'), false) AS service, coalesce(regexp_matches(StockCode, '^[A-Z ]+$'), false) AS special,
      starts_with(InvoiceNo, 'A') OR coalesce(StockCode = 'B', false) OR coalesce(upper(trim(Description)) = 'ADJUST BAD DEBT', false) AS accounting
    FROM retail
  )
)"""
INVOICES = """invoices AS (
  SELECT k_invoice, count(*) AS invoice_lines, count(*) FILTER (UnitPrice > 0) AS positive_price_lines, count(*) FILTER (UnitPrice = 0) AS zero_price_lines, count(DISTINCT k_customer) AS customer_count,
    count(k_customer) AS identified_lines, count(DISTINCT k_country) AS country_count, count(DISTINCT CAST(InvoiceDate AS DATE)) AS date_count, bool_or(k_stock = 'DOT') AS has_dotcom_postage,
    bool_or(UnitPrice > 0 AND NOT accounting) AS retail_priced
  FROM base GROUP BY k_invoice
)"""
TYPED = """typed AS (
  SELECT *, CASE WHEN channel = 'identified' THEN 'identified' WHEN channel IN ('retail_web', 'retail_other') THEN 'retail' END AS baseline_group
  FROM (
    SELECT b.*, i.* EXCLUDE (k_invoice),
      CASE WHEN accounting THEN 'accounting_adjustment' WHEN cancel THEN 'cancellation' WHEN service OR special THEN 'fee_service'
        WHEN UnitPrice = 0 AND k_customer IS NULL AND positive_price_lines = 0 THEN 'inventory_adjustment' WHEN Quantity > 0 AND UnitPrice > 0 THEN 'sale'
        WHEN UnitPrice = 0 AND Quantity > 0 THEN 'zero_price_line' ELSE 'unclassified' END AS record_type,
      CASE WHEN identified_lines > 0 THEN 'identified' WHEN has_dotcom_postage THEN 'retail_web' WHEN retail_priced THEN 'retail_other' ELSE 'internal' END AS channel
    FROM base b JOIN invoices i ON b.k_invoice = i.k_invoice
  )
)"""


def typed(stock: str = "part") -> str:
    return ", ".join([retail(stock), BASE, INVOICES, TYPED])


def baseline(name: str, source: str, keys: str, value: str) -> str:
    """CTE name: keys, n, med, mad."""
    first = keys.split(",")[0].strip()
    on = " AND ".join(f"v.{k.strip()} = c.{k.strip()}" for k in keys.split(","))
    return f"""{name}_v AS (SELECT {keys}, {value} AS v FROM {source} WHERE {first} IS NOT NULL AND {value} IS NOT NULL), {name}_c AS (SELECT {keys}, count(*) AS n, quantile_cont(v, 0.5) AS med FROM {name}_v GROUP BY {keys}),
{name} AS (SELECT {", ".join("c." + k.strip() for k in keys.split(","))}, any_value(n) AS n, any_value(med) AS med, quantile_cont(abs(v.v - med), 0.5) AS mad FROM {name}_v v JOIN {name}_c c ON {on} GROUP BY {", ".join("c." + k.strip() for k in keys.split(","))})"""


BASELINES = ", ".join([
    "sales AS (SELECT *, ln(CAST(Quantity AS DOUBLE)) AS lq, ln(UnitPrice) AS lp FROM typed WHERE record_type = 'sale' AND InvoiceDate IS NOT NULL AND baseline_group IS NOT NULL AND k_stock IS NOT NULL)",
    "known AS (SELECT * FROM sales WHERE baseline_group = 'identified' AND k_customer IS NOT NULL)",
    baseline("q1", "known", "k_customer, k_stock", "lq"),
    baseline("p1", "known", "k_customer, k_stock", "lp"),
    baseline("q3", "sales", "baseline_group, k_stock", "lq"),
    baseline("p3", "sales", "baseline_group, k_stock", "lp"),
    "stock AS (SELECT k_stock, med AS stock_med FROM q3 WHERE baseline_group = 'identified' AND n >= 30)",
    "against AS (SELECT k_customer, lq - stock_med AS lq FROM known JOIN stock USING (k_stock))",
    baseline("q2", "against", "k_customer", "lq"),
])
JUDGED = """levels AS (
  SELECT t.*, CASE WHEN record_type <> 'sale' THEN 'outside_scope' WHEN t.baseline_group IS NULL THEN 'missing_invoice_no' END AS outside, s.stock_med,
    CASE WHEN t.baseline_group = 'identified' AND q1.n >= 5 THEN 'customer_stock' WHEN t.baseline_group = 'identified' AND q2.n >= 20 AND s.stock_med IS NOT NULL THEN 'customer' WHEN q3.n >= 30 THEN 'channel_stock' END AS q_level,
    CASE WHEN t.baseline_group = 'identified' AND p1.n >= 5 THEN 'customer_stock' WHEN p3.n >= 30 THEN 'channel_stock' END AS p_level,
    q1.n AS q1_n, q1.med AS q1_med, q1.mad AS q1_mad, q2.n AS q2_n, q2.med AS q2_med, q2.mad AS q2_mad, q3.n AS q3_n, q3.med AS q3_med, q3.mad AS q3_mad,
    p1.n AS p1_n, p1.med AS p1_med, p1.mad AS p1_mad, p3.n AS p3_n, p3.med AS p3_med, p3.mad AS p3_mad,
    CASE WHEN Quantity > 0 THEN ln(CAST(Quantity AS DOUBLE)) END AS lq, CASE WHEN UnitPrice > 0 THEN ln(UnitPrice) END AS lp
  FROM typed t LEFT JOIN q1 ON t.k_customer = q1.k_customer AND t.k_stock = q1.k_stock LEFT JOIN p1 ON t.k_customer = p1.k_customer AND t.k_stock = p1.k_stock
    LEFT JOIN q3 ON t.baseline_group = q3.baseline_group AND t.k_stock = q3.k_stock LEFT JOIN p3 ON t.baseline_group = p3.baseline_group AND t.k_stock = p3.k_stock
    LEFT JOIN stock s ON t.k_stock = s.k_stock LEFT JOIN q2 ON t.k_customer = q2.k_customer
), picked AS (
  SELECT *, coalesce(outside, CASE WHEN q_level IS NULL THEN 'insufficient_history' END) AS q_reason, coalesce(outside, CASE WHEN p_level IS NULL THEN 'insufficient_history' END) AS p_reason,
    CASE q_level WHEN 'customer' THEN lq - stock_med ELSE lq END AS qx, CASE q_level WHEN 'customer_stock' THEN q1_med WHEN 'customer' THEN q2_med WHEN 'channel_stock' THEN q3_med END AS qmed,
    CASE q_level WHEN 'customer_stock' THEN q1_mad WHEN 'customer' THEN q2_mad WHEN 'channel_stock' THEN q3_mad END AS qmad, CASE q_level WHEN 'customer_stock' THEN q1_n WHEN 'customer' THEN q2_n WHEN 'channel_stock' THEN q3_n END AS qn,
    CASE p_level WHEN 'customer_stock' THEN p1_med WHEN 'channel_stock' THEN p3_med END AS pmed, CASE p_level WHEN 'customer_stock' THEN p1_mad WHEN 'channel_stock' THEN p3_mad END AS pmad, CASE p_level WHEN 'customer_stock' THEN p1_n WHEN 'channel_stock' THEN p3_n END AS pn
  FROM levels
), measured AS (
  SELECT *, round(exp(qx - qmed), 6) AS qfold, round(exp(lp - pmed), 6) AS pfold, CASE WHEN qmad > 0 THEN 0.6745 * (qx - qmed) / qmad END AS qz, CASE WHEN pmad > 0 THEN 0.6745 * (lp - pmed) / pmad END AS pz,
    round(exp(qmed + CASE q_level WHEN 'customer' THEN stock_med ELSE 0 END), 6) AS qexpected, round(exp(pmed), 6) AS pexpected
  FROM picked
), judged AS (
  SELECT *, q_reason IS NULL AND coalesce(CASE WHEN qmad > 0 THEN qz > 3.5 ELSE qx > qmed END AND qfold >= 3, false) AS q_flag,
    p_reason IS NULL AND coalesce(CASE WHEN pmad > 0 THEN abs(pz) > 3.5 ELSE lp <> pmed END AND abs(pfold - 1) >= 0.3, false) AS p_flag,
    CAST(round(CAST((Quantity - qexpected) * UnitPrice AS DECIMAL(28,6)), 2) AS DOUBLE) AS q_value, CAST(round(CAST(abs(UnitPrice - pexpected) * Quantity AS DECIMAL(28,6)), 2) AS DOUBLE) AS p_value
  FROM measured
)"""
OPERATIONAL = """prices AS (SELECT k_stock, quantile_cont(UnitPrice, 0.5) AS stock_price FROM typed WHERE record_type = 'sale' AND InvoiceDate IS NOT NULL GROUP BY k_stock),
bought AS (SELECT k_customer, k_stock, sum(CASE WHEN record_type = 'sale' AND InvoiceDate IS NOT NULL THEN Quantity END) AS purchased, sum(CASE WHEN record_type = 'cancellation' THEN abs(Quantity) END) AS returned FROM typed WHERE k_customer IS NOT NULL GROUP BY k_customer, k_stock),
operated AS (
  SELECT t.*, stock_price, coalesce(purchased, 0) AS purchased, returned,
    CASE WHEN record_type <> 'zero_price_line' THEN 'outside_scope' END AS zero_reason,
    CASE WHEN record_type <> 'cancellation' THEN 'outside_scope' WHEN t.k_customer IS NULL THEN 'no_customer_history' WHEN service OR special THEN 'service_or_special_code'
      WHEN InvoiceDate < (SELECT min(InvoiceDate) FROM typed) + INTERVAL 30 DAY THEN 'history_window_start' END AS return_reason,
    CAST(round(CAST(abs(CAST(Quantity AS DOUBLE)) * stock_price AS DECIMAL(28,6)), 2) AS DOUBLE) AS worth
  FROM judged t LEFT JOIN prices USING (k_stock) LEFT JOIN bought b ON t.k_customer = b.k_customer AND t.k_stock = b.k_stock
)"""


def _severity(value: str) -> str:
    return f"CASE WHEN {value} >= 1000 THEN 'high' WHEN {value} >= 100 THEN 'medium' ELSE 'low' END"


def _rule(tier: str, rule: str, reason: str, flag: str, severity: str, value: str = "NULL", level: str = "NULL", fold: str = "NULL", z: str = "NULL", observed: str = "NULL") -> str:
    shown = lambda x: f"CASE WHEN ({reason}) IS NULL THEN {x} END"
    return f"""SELECT id, InvoiceNo, StockCode, Quantity, channel, record_type, '{tier}' AS tier, '{rule}' AS rule, CASE WHEN ({reason}) IS NOT NULL THEN 'not_applied' WHEN coalesce({flag}, false) THEN 'flagged' ELSE 'not_flagged' END AS status,
  {reason} AS reason, {shown(f"CAST({level} AS VARCHAR)")} AS context_level, CAST({observed} AS DOUBLE) AS observed_value, {shown(f"CAST({value} AS DOUBLE)")} AS value_at_risk, {shown(f"CAST({fold} AS DOUBLE)")} AS fold_change, {shown(f"CAST({z} AS DOUBLE)")} AS robust_z,
  CASE WHEN ({reason}) IS NULL AND coalesce({flag}, false) THEN {severity} END AS severity FROM numbered"""


NONE = "CAST(NULL AS VARCHAR)"
CHECKS = "numbered AS (SELECT *, row_number() OVER () AS id FROM operated), checks AS (" + "\nUNION ALL ".join([
    _rule("data", "missing_required_field", NONE, "Quantity IS NULL OR k_country IS NULL", "'high'"),
    _rule("data", "missing_description", NONE, "k_description IS NULL", "'low'"),
    _rule("data", "invalid_numeric_value", NONE, "Quantity IS NULL", "'high'"),
    _rule("data", "cancel_sign_conflict", "CASE WHEN Quantity IS NULL THEN 'invalid_numeric_value' END", "(cancel AND Quantity >= 0) OR (NOT cancel AND Quantity < 0 AND record_type NOT IN ('inventory_adjustment', 'accounting_adjustment'))", "'medium'", observed="Quantity"),
    _rule("data", "negative_price_outside_adjustment", NONE, "UnitPrice < 0 AND record_type <> 'accounting_adjustment'", "'high'", observed="UnitPrice"),
    _rule("data", "invoice_multiple_customers", "CASE WHEN customer_count < 2 AND identified_lines <> invoice_lines THEN 'incomplete_customer_ids' END", "customer_count >= 2", "'medium'", observed="customer_count"),
    _rule("data", "invoice_inconsistent_header", NONE, "country_count > 1 OR date_count > 1", "'medium'"),
    _rule("business", "quantity_deviation", "q_reason", "q_flag", _severity("q_value"), "q_value", "q_level", "qfold", "qz", "Quantity"),
    _rule("business", "price_deviation", "p_reason", "p_flag", _severity("p_value"), "p_value", "p_level", "pfold", "pz", "UnitPrice"),
    _rule("business", "zero_price_sale_line", "zero_reason", "positive_price_lines > 0", _severity("worth"), "worth", observed="Quantity"),
    _rule("business", "all_zero_price_invoice", "zero_reason", "positive_price_lines = 0", _severity("worth"), "worth", observed="Quantity"),
    _rule("business", "inventory_adjustment", "CASE WHEN record_type <> 'inventory_adjustment' THEN 'outside_scope' END", "true", _severity("worth"), "worth", observed="Quantity"),
    _rule("business", "manual_accounting_entry", "CASE WHEN record_type <> 'accounting_adjustment' THEN 'outside_scope' END", "true", "'high'", "CAST(round(CAST(abs(line_value) AS DECIMAL(28,6)), 2) AS DOUBLE)", observed="line_value"),
    _rule("business", "unmatched_return", "return_reason", "returned > purchased", _severity("CAST(round(CAST(abs(line_value) AS DECIMAL(28,6)), 2) AS DOUBLE)"), "CAST(round(CAST(abs(line_value) AS DECIMAL(28,6)), 2) AS DOUBLE)", observed="returned"),
]) + ")"


def checks(stock: str = "part") -> str:
    return ", ".join([typed(stock), BASELINES, JUDGED, OPERATIONAL, CHECKS])


ORDERS = ", ".join([
    """lines AS (
  SELECT *, upper(trim(InvoiceNo)) AS invoice_key, nullif(trim(CustomerID), '') AS customer_key,
    coalesce(Quantity > 0 AND UnitPrice > 0 AND InvoiceDate < TIMESTAMP '2001-01-01' AND trim(Country) <> '', false) AS valid_line, starts_with(InvoiceNo, 'A') AS acc FROM retail
), rolled AS (
  SELECT invoice_key, count(*) AS line_count, count(*) FILTER (NOT valid_line) AS invalid_lines, count(DISTINCT customer_key) AS customer_ids, max(customer_key) AS customer_key, count(DISTINCT Country) AS countries,
    count(DISTINCT CAST(InvoiceDate AS DATE)) AS invoice_days, CAST(round(sum(CASE WHEN valid_line THEN CAST(Quantity AS DECIMAL(18,4)) * CAST(round(CAST(UnitPrice AS DECIMAL(18,6)), 4) AS DECIMAL(18,4)) END), 2) AS DOUBLE) AS partial_total,
    bool_or(StockCode = 'DOT') AS has_dot, bool_or(UnitPrice > 0 AND NOT acc) AS has_price
  FROM lines GROUP BY invoice_key
), grouped AS (
  SELECT *, CASE WHEN customer_ids > 0 THEN 'identified' WHEN has_dot THEN 'retail_web' WHEN has_price THEN 'retail_other' ELSE 'internal' END AS channel,
    CASE WHEN customer_ids > 0 THEN 'identified' WHEN has_dot OR has_price THEN 'retail' END AS baseline_group,
    NOT starts_with(invoice_key, 'C') AND invalid_lines = 0 AND customer_ids <= 1 AND countries = 1 AND invoice_days = 1 AS eligible FROM rolled
), totals AS (SELECT *, CASE WHEN eligible THEN partial_total END AS order_total, CASE WHEN eligible AND partial_total > 0 THEN ln(partial_total) END AS lt FROM grouped),
reference AS (SELECT * FROM totals WHERE eligible AND order_total > 0 AND baseline_group IS NOT NULL), own AS (SELECT * FROM reference WHERE baseline_group = 'identified')""",
    baseline("o1", "own", "customer_key", "lt"),
    baseline("o2", "reference", "baseline_group", "lt"),
    """leveled AS (
  SELECT t.*, CASE WHEN t.baseline_group = 'identified' AND o1.n >= 5 THEN 'customer' WHEN o2.n >= 30 THEN 'channel' END AS level,
    CASE WHEN t.baseline_group = 'identified' AND o1.n >= 5 THEN o1.med WHEN o2.n >= 30 THEN o2.med END AS med, CASE WHEN t.baseline_group = 'identified' AND o1.n >= 5 THEN o1.mad WHEN o2.n >= 30 THEN o2.mad END AS mad
  FROM totals t LEFT JOIN o1 ON t.customer_key = o1.customer_key LEFT JOIN o2 ON t.baseline_group = o2.baseline_group
), reasoned AS (
  SELECT *, CASE WHEN starts_with(invoice_key, 'C') THEN 'cancelled_invoice' WHEN invalid_lines > 0 THEN 'invalid_invoice_lines' WHEN customer_ids > 1 THEN 'multiple_customer_ids' WHEN countries <> 1 THEN 'inconsistent_country'
      WHEN invoice_days <> 1 THEN 'inconsistent_invoice_date' WHEN baseline_group IS NULL OR coalesce(order_total, 0) <= 0 THEN 'outside_scope' WHEN level IS NULL THEN 'insufficient_history' END AS reason,
    round(exp(lt - med), 6) AS fold, CAST(round(CAST(order_total - round(exp(med), 6) AS DECIMAL(28,6)), 2) AS DOUBLE) AS value FROM leveled
), assessed AS (
  SELECT *, CASE WHEN reason IS NOT NULL THEN 'not_assessable' WHEN coalesce(CASE WHEN mad > 0 THEN 0.6745 * (lt - med) / mad > 3.5 ELSE lt > med END AND fold >= 3, false) THEN 'flagged' ELSE 'not_flagged' END AS status FROM reasoned
)""",
])


def dec(x: str, places: int = 4) -> str:
    """A number fit for comparing across engines."""
    return f"CAST(round(CAST({x} AS DECIMAL(28,6)), {places}) AS DOUBLE)"
