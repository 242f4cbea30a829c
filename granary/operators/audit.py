"""Row audit: seven data rules and seven business rules over transactions, each with its evidence.

Three tables of SQL say all of it: DERIVED columns of a row, RULES, and the LEVELS of baselines a deviation is measured against. The history is
read once, dealt by invoice, and the classified rows are staged; every reference (baselines, prices, balances, product names)
is an aggregate of a few columns of that table, and only those that the rules at hand need are joined to it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from granary.config import DEFAULT, Config
from granary.functions.exprs import compact_flags, finite, normalized, truth
from granary.operators.baselines import compared, counted_median, robust_baselines
from granary.operators.clean import audit_history
from granary.operators.rules import Rule, judged, out_of_scope, raw_sql
from granary.schema import COLUMNS, ContractError, require_types
from granary.sources.staging import stage

# Words in descriptions that speak of stock, damage, loss and coding rather than of a product.
KEYWORDS = {
    "stock_words": r"\b(?:CHECK(?:ED|ING|S)?|ADJUST(?:ED|MENT|MENTS|ING)?|COUNTED|STOCK|HISTORIC|FOUND|TEST(?:ING|ED|S)?)\b",
    "damage_words": r"\b(?:DAMAG(?:E|ED|ES|ING)|DAGAM(?:E|ED)|FAULT(?:Y|S)?|MOULD(?:Y)?|WET|RUST(?:Y)?|SMASH(?:ED)?|CRUSH(?:ED)?|CRACK(?:ED)?|BROKEN|BREAKAGE|UNSALEABLE|THROWN)\b",
    "loss_words": r"\b(?:MISSING|LOST|MIA|NOT RCVD|CAN['’]?T FIND)\b",
    "coding_words": r"\b(?:WRONG(?:LY)?|INCORRECT(?:LY)?|BARCODE|MIXED UP|MARKED|MRKED|CODED)\b",
}

# ---------------------------------------------------------------------------------------------- classification

#: Conditions on a row by itself; unknown is false.
DERIVED = {
    "cancel": "k_invoice like 'C%'",
    "special": "k_stock rlike '^[A-Z ]+$'",
    "accounting": "k_invoice like 'A%' or k_stock = 'B' or k_description = 'ADJUST BAD DEBT'",
    "sale_shape": "k_invoice not like 'C%' and Quantity > 0 and UnitPrice > 0 and line_value > 0",
}
QUALITY = {
    "missing_customer_id": "k_customer is null", "missing_invoice_no": "k_invoice is null", "missing_stock_code": "k_stock is null", "missing_description": "k_description is null", "missing_country": "k_country is null",
    "missing_invoice_date": "InvoiceDate is null", "invalid_quantity": "Quantity is null", "invalid_unit_price": "not priced", "invalid_line_value": "line_value is null",
}
#: Aggregates of an invoice.
INVOICE = {
    "invoice_lines": "count(*)", "priced_lines": "count_if(priced)", "positive_price_lines": "count_if(priced and UnitPrice > 0)", "zero_price_lines": "count_if(priced and UnitPrice = 0)",
    "customer_count": "count(distinct k_customer)", "identified_lines": "count(k_customer)", "country_count": "count(distinct k_country)", "date_count": "count(distinct to_date(InvoiceDate))",
    "has_dotcom_postage": "bool_or(coalesce(k_stock = 'DOT', false))", "retail_priced": "bool_or(coalesce(priced and UnitPrice > 0 and not accounting, false))",
}
#: What a row is, what its invoice came by, and whose baselines it belongs to: the first that holds.
RECORD_TYPES = {
    "accounting_adjustment": "accounting", "cancellation": "cancel", "fee_service": "service or special", "inventory_adjustment": "UnitPrice = 0 and k_customer is null and coalesce(positive_price_lines, 0) = 0",
    "sale": "Quantity > 0 and UnitPrice > 0 and line_value > 0", "zero_price_line": "UnitPrice = 0 and Quantity > 0", "unclassified": "true",
}
CHANNELS = {"unknown": "k_invoice is null", "identified": "identified_lines > 0", "retail_web": "has_dotcom_postage", "retail_other": "retail_priced", "internal": "true"}
GROUPS = {"identified": "channel = 'identified'", "retail": "channel in ('retail_web', 'retail_other')"}
#: Context of a row beside its words.
CONTEXT = {"cancelled_invoice": "cancel", "service_line": "service", "special_stock_code": "special", "zero_negative": "UnitPrice = 0 and Quantity < 0", "zero_positive": "UnitPrice = 0 and Quantity > 0", "sale_shape": "sale_shape"}


def first_sql(choices: dict[str, str]) -> str:
    return "case " + " ".join(f"when {condition} then '{name}'" for name, condition in choices.items()) + " end"


def base_columns(history: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Normalised keys, the line's value and shape, and data quality flags."""
    key = {"k_invoice": "InvoiceNo", "k_stock": "StockCode", "k_customer": "CustomerID", "k_description": "Description", "k_country": "Country"}
    keyed = history.select(*COLUMNS, *[F.col(k) if k in history.columns else normalized(F.col(c), c == "Description").alias(k) for k, c in key.items()], finite(F.col("UnitPrice")).alias("priced"), F.expr("cast(Quantity as double) * UnitPrice").alias("amount"))
    service = truth(F.col("k_stock").isin(*config.clean.service_codes)) | truth(F.col("k_description").isin(*config.clean.service_descriptions))
    keyed = keyed.withColumns({"line_value": F.when(F.col("priced") & finite(F.col("amount")), F.col("amount")), "service": service}).drop("amount")
    return keyed.withColumns({n: F.expr(f"coalesce({x}, false)") for n, x in DERIVED.items()}).withColumn("data_quality_flags", compact_flags((n, F.expr(x)) for n, x in QUALITY.items()))


def invoice_summary(rows: DataFrame) -> DataFrame:
    """Counts of each invoice. rows: base columns."""
    return rows.where("k_invoice is not null").groupBy("k_invoice").agg(*[F.expr(x).alias(n) for n, x in INVOICE.items()])


def _over(x: str, rows: WindowSpec) -> Column:
    """One of INVOICE over a window; rows without an invoice have nothing to tell apart."""
    distinct = re.fullmatch(r"count\(distinct (.*)\)", x)
    return F.size(F.collect_set(F.expr(f"if(k_invoice is null, null, {distinct[1]})")).over(rows)).cast("bigint") if distinct else F.expr(x).over(rows)


def classified(history: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Base columns with their invoice's counts, record_type, channel and baseline_group.

    The counts are taken over each invoice's rows where they lie together, so rows are dealt by invoice once and the history is read once.
    """
    rows = base_columns(history.withColumn("k_invoice", normalized(F.col("InvoiceNo"))).repartition("k_invoice"), config)
    of_invoice = Window.partitionBy("k_invoice")
    known = rows.withColumns({n: _over(x, of_invoice) for n, x in INVOICE.items()})
    known = known.withColumns({n: F.expr(f"if(k_invoice is null, null, {n})") for n in INVOICE}).withColumn("has_dotcom_postage", F.expr("coalesce(has_dotcom_postage, false)"))
    return known.withColumns({"record_type": F.expr(first_sql(RECORD_TYPES)), "channel": F.expr(first_sql(CHANNELS))}).withColumn("baseline_group", F.expr(first_sql(GROUPS)))


def description_context(rows: DataFrame) -> DataFrame:
    """rows with context_flags. A description that the stock code bears on two sales invoices is a product name, whatever its words."""
    shown = rows.where("InvoiceDate is not null and k_stock is not null and k_description is not null and k_invoice is not null and sale_shape and not service and not special")
    # two invoices at least: the first isn't the last
    names = shown.groupBy("k_stock", "k_description").agg(F.min("k_invoice").alias("a"), F.max("k_invoice").alias("b")).where("a < b").select("k_stock", "k_description", F.lit(True).alias("is_name"))
    stocks = names.select("k_stock").distinct().withColumn("has_names", F.lit(True))
    worded = rows.withColumn("worded", truth(F.col("k_description").rlike("|".join(KEYWORDS.values()))))
    joined = worded.join(names, ["k_stock", "k_description"], "left").join(stocks, "k_stock", "left")
    stray = F.expr("worded and has_names and is_name is null")  # the words are looked at one by one only where they tell something
    flags = {n: F.expr(x) for n, x in CONTEXT.items()} | {"keyword_product_name": F.expr("worded and is_name"), "keyword_unresolved": F.expr("worded and has_names is null")}
    flags |= {n: F.when(stray, F.col("k_description").rlike(pattern)) for n, pattern in KEYWORDS.items()}
    return joined.withColumn("context_flags", compact_flags(flags.items())).drop("is_name", "has_names", "worded")


# ---------------------------------------------------------------------------------------------- references

LOG = {"quantity": "case when Quantity > 0 then ln(cast(Quantity as double)) end", "price": "case when UnitPrice > 0 then ln(UnitPrice) end"}
#: For each measure, nearest first: level, its baseline, the samples it needs (a limit of the configuration), when it applies, and the shift of its scale.
LEVELS = {
    "quantity": (
        ("customer_stock", "pair_quantity", "min_customer_stock_lines", "baseline_group = 'identified'", "0D"),
        ("customer", "customer_quantity", "min_customer_lines", "baseline_group = 'identified' and usual is not null", "usual"),
        ("channel_stock", "group_quantity", "min_samples", "true", "0D"),
    ),
    "price": (
        ("customer_stock", "pair_price", "min_customer_stock_lines", "baseline_group = 'identified'", "0D"),
        ("channel_stock", "group_price", "min_samples", "true", "0D"),
    ),
}


def sale_baselines(rows: DataFrame, config: Config = DEFAULT) -> dict[str, tuple[list[str], DataFrame]]:
    """keys and table of each baseline: pair (customer and stock), group (channel group and stock), customer (against a stock's usual, its median to identified customers)."""
    sales = rows.where("record_type = 'sale' and InvoiceDate is not null and baseline_group is not null and k_stock is not null")
    known = sales.where("baseline_group = 'identified' and k_customer is not null")
    measures = {m: F.expr(x) for m, x in LOG.items()}
    pair, group = ["k_customer", "k_stock"], ["baseline_group", "k_stock"]
    by_group = stage(robust_baselines(sales, group, **{f"group_{m}": x for m, x in measures.items()}), "baselines")  # looked at twice
    # a customer's own level rests on stocks whose median is itself well founded
    usual = by_group.select("k_stock", F.expr(usual_sql(config)).alias("usual")).where("usual is not null")
    return {
        "pair": (pair, robust_baselines(known, pair, fine=True, **{f"pair_{m}": x for m, x in measures.items()})),
        "group": (group, by_group),
        "customer": (["k_customer"], robust_baselines(known.join(usual, "k_stock"), ["k_customer"], fine=True, customer_quantity=measures["quantity"] - F.col("usual"))),
    }


def usual_sql(config: Config = DEFAULT) -> str:
    """A stock's usual, from its baselines of identified customers."""
    return f"case when baseline_group = 'identified' and group_quantity.n >= {config.audit.min_samples} then group_quantity.med end"


def firm(config: Config = DEFAULT) -> dict[str, tuple[str, ...]]:
    """For each table of baselines when one of a row has the samples that its level asks for."""
    found: dict[str, tuple[str, ...]] = {}
    for levels in LEVELS.values():
        for _, base, least, _, _ in levels:
            table = base.split("_")[0]
            found[table] = (*found.get(table, ()), f"{base}.n >= {getattr(config.audit, least)}")
    return found


def references(rows: DataFrame, needs: frozenset[str], config: Config = DEFAULT) -> list[tuple[list[str], DataFrame]]:
    """keys and tables of what is needed; no keys: one row. Baselines with too few samples serve no level; the others are staged, so that their size is known before rows are dealt to them."""
    found = {}
    if "deviation" in needs:
        well_founded = firm(config)
        for t, (keys, table) in sale_baselines(rows, config).items():
            found[t] = keys, stage(table.where(" or ".join(well_founded[t])), "baselines")
    sales = rows.where("record_type = 'sale' and InvoiceDate is not null")
    if "price" in needs:
        found["price"] = ["k_stock"], counted_median(sales, ["k_stock"], "UnitPrice", "stock_price")
    if "balance" in needs:
        moved = rows.where("k_customer is not null and (record_type = 'cancellation' or (record_type = 'sale' and InvoiceDate is not null))")
        found["balance"] = ["k_customer", "k_stock"], moved.groupBy("k_customer", "k_stock").agg(F.expr("sum(cast(Quantity as bigint)) filter (where record_type = 'sale')").alias("bought"), F.expr("sum(abs(cast(Quantity as double))) filter (where record_type = 'cancellation')").alias("returned"))
        found["start"] = [], rows.agg(F.min("InvoiceDate").alias("history_start"))
    return list(found.values())


def measured(rows: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """rows joined to their baselines, with <measure>_base (the nearest level: level, n, med, mad, shift), <measure>_lies, <measure>_expected and <measure>_risk."""
    limits = config.audit
    rows = rows.withColumn("usual", F.expr(usual_sql(config)))
    for m, levels in LEVELS.items():
        some = [f"case when {when} and {base}.n >= {getattr(limits, least)} then named_struct('level', '{name}', 'n', {base}.n, 'med', {base}.med, 'mad', {base}.mad, 'shift', {shift}) end" for name, base, least, when, shift in levels]
        rows = rows.withColumn(f"{m}_base", F.expr(f"coalesce({', '.join(some)})"))
    base = {m: F.col(f"{m}_base") for m in LEVELS}
    rows = rows.withColumns({f"{m}_lies": compared(F.expr(LOG[m]) - base[m]["shift"], base[m], limits.mad_constant, limits.z_threshold, m == "price") for m in LEVELS} | {f"{m}_expected": F.round(F.exp(base[m]["med"] + base[m]["shift"]), 6) for m in LEVELS})
    risk = {"quantity": "(Quantity - quantity_expected) * UnitPrice", "price": "abs(UnitPrice - price_expected) * Quantity"}
    return rows.withColumns({f"{m}_risk": F.expr(f"round({x}, 2)") for m, x in risk.items()}).drop("pair_quantity", "pair_price", "group_quantity", "group_price", "customer_quantity", "usual")


# ---------------------------------------------------------------------------------------------- rules


def deviation_rule(m: str, observed: str, material: str) -> Rule:
    skip = {"outside_scope": "record_type <> 'sale'", "missing_invoice_date": "InvoiceDate is null", "missing_invoice_no": "baseline_group is null", "insufficient_history": f"{m}_base is null"}
    evidence = {"context_level": f"{m}_base.level", "reference_count": f"{m}_base.n", "reference_median": f"{m}_expected", "reference_mad": f"{m}_base.mad", "robust_z": f"{m}_lies.z", "fold_change": f"{m}_lies.fold", "value_at_risk": f"{m}_risk"}
    return Rule("business", f"{m}_deviation", f"{m}_lies.beyond and {material}", None, skip, observed, evidence, frozenset({"deviation"}), ("sale",))


def rules(config: Config = DEFAULT) -> tuple[Rule, ...]:
    """All rules in the order of their results."""
    limits = config.audit
    alone = {"missing_invoice_no": "k_invoice is null"}
    lines = {"reference_count": "invoice_lines"}
    worth = {"value_at_risk": "round(abs(cast(Quantity as double)) * stock_price, 2)"}
    own = {"value_at_risk": "round(abs(line_value), 2)"}
    beyond = lambda kind: {"outside_scope": f"record_type <> '{kind}'"}
    free = beyond("zero_price_line") | alone
    priced = frozenset({"price"})
    return (
        Rule("data", "missing_required_field", "k_invoice is null or k_stock is null or InvoiceDate is null or Quantity is null or UnitPrice is null or k_country is null", "high"),
        Rule("data", "missing_description", "k_description is null", "low"),
        Rule("data", "invalid_numeric_value", "Quantity is null or not priced or line_value is null", "high"),
        Rule("data", "cancel_sign_conflict", "if(cancel, Quantity >= 0, Quantity < 0 and record_type not in ('inventory_adjustment', 'accounting_adjustment'))", "medium", alone | {"invalid_numeric_value": "Quantity is null"}, "Quantity"),
        Rule("data", "negative_price_outside_adjustment", "UnitPrice < 0 and record_type <> 'accounting_adjustment'", "high", {"invalid_numeric_value": "not priced"}, "UnitPrice"),
        Rule("data", "invoice_multiple_customers", "customer_count >= 2", "medium", alone | {"incomplete_customer_ids": "customer_count < 2 and identified_lines <> invoice_lines"}, "customer_count", lines),
        Rule("data", "invoice_inconsistent_header", "country_count > 1 or date_count > 1", "medium", alone, evidence=lines),
        deviation_rule("quantity", "Quantity", f"quantity_lies.fold >= {limits.quantity_min_fold}D"),
        deviation_rule("price", "UnitPrice", f"abs(price_lies.fold - 1) >= {limits.price_min_relative}D"),
        Rule("business", "zero_price_sale_line", "positive_price_lines > 0", None, free, "Quantity", worth, priced, ("zero_price_line",)),
        Rule("business", "all_zero_price_invoice", "positive_price_lines = 0", None, free, "Quantity", worth | lines, priced, ("zero_price_line",)),
        Rule("business", "inventory_adjustment", "true", None, beyond("inventory_adjustment"), "Quantity", worth, priced, ("inventory_adjustment",)),
        Rule("business", "manual_accounting_entry", "true", "high", beyond("accounting_adjustment"), "line_value", own),
        Rule("business", "unmatched_return", "returned > coalesce(bought, 0)", None, beyond("cancellation") | {"no_customer_history": "k_customer is null", "service_or_special_code": "service or special", "missing_invoice_date": "InvoiceDate is null", "history_window_start": f"InvoiceDate < history_start + make_dt_interval({limits.return_window_days})"}, "returned", own | {"reference_count": "coalesce(bought, 0)"}, frozenset({"balance"}), ("cancellation",)),
    )


TIERS = {r.name: r.tier for r in rules()}
RULES = tuple(TIERS)
DATA_RULES = tuple(n for n, tier in TIERS.items() if tier == "data")
BUSINESS_RULES = tuple(n for n, tier in TIERS.items() if tier == "business")


def with_results(rows: DataFrame, some: tuple[Rule, ...], config: Config = DEFAULT, of: DataFrame | None = None) -> DataFrame:
    """rows (classified, staged), or `of` them, with check_results of some rules, joined to what those need."""
    needs = frozenset().union(*(r.needs for r in some))
    joined = reduce(lambda df, r: df.join(r[1], r[0], "left") if r[0] else df.crossJoin(F.broadcast(r[1])), references(rows, needs, config), rows if of is None else of)
    return judged(measured(joined, config) if "deviation" in needs else joined, some, config.audit)


#: What references are made of.
REFERRED = ("record_type", "baseline_group", "k_customer", "k_stock", "InvoiceDate", "Quantity", "UnitPrice")


def facts(history: DataFrame, some: tuple[Rule, ...], *keep: str, config: Config = DEFAULT) -> DataFrame:
    """The classified rows as a written table, with no other columns than those that some rules name and those to keep."""
    rows = classified(history, config)
    named = {*REFERRED, *keep}.union(*(re.findall(r"\w+", raw_sql(r)) for r in some))
    return stage(rows.select(*[c for c in rows.columns if c in named]), "classified")


def parts(rows: DataFrame, some: tuple[Rule, ...], config: Config = DEFAULT) -> Iterator[DataFrame]:
    """rows (classified, staged) with check_results of some rules, in parts that hold every row once.

    A type of record asks for one table of reference at most, so each part is joined to its own alone. A rule that doesn't apply to a part's
    types tells only that there. Write a part before the next: what one is dealt by is then gone from disk.
    """
    types = {needs: tuple(sorted({k for r in some if r.needs == needs for k in r.kinds})) for needs in dict.fromkeys(r.needs for r in some if r.needs)}
    quoted = lambda names: ", ".join(f"'{n}'" for n in names)
    for needs, kinds in types.items():
        yield with_results(rows, tuple(r if r.needs in (frozenset(), needs) else out_of_scope(r) for r in some), config, rows.where(f"record_type in ({quoted(kinds)})"))
    rest = f"record_type not in ({quoted(k for kinds in types.values() for k in kinds)})" if types else "true"
    yield with_results(rows, tuple(out_of_scope(r) if r.needs else r for r in some), config, rows.where(rest))


def concluded(rows: DataFrame) -> DataFrame:
    """rows with check_results, and the flags, worst severity and status that follow from them."""
    named = lambda tier: F.expr(f"transform(filter(check_results, c -> c.status = 'flagged' and c.tier = '{tier}'), c -> c.rule)")
    rows = rows.withColumns({"data_anomaly_flags": named("data"), "business_anomaly_flags": named("business"), "severities": F.expr("transform(check_results, c -> c.severity)"), "open": F.expr("exists(check_results, c -> c.status = 'not_flagged')")})
    worst = first_sql({s: f"array_contains(severities, '{s}')" for s in ("high", "medium", "low")})
    return rows.withColumns({"max_severity": F.expr(worst), "anomaly_flags": F.concat("data_anomaly_flags", "business_anomaly_flags")}).withColumn(
        "assessment_status", F.expr("case when max_severity is not null then 'flagged' when open then 'not_flagged' else 'not_assessable' end"))


def audit(transactions: DataFrame, run_date: str, config: Config = DEFAULT) -> DataFrame:
    """Every row before the cutoff (or without a date) with its checks, flags, worst severity and status. The classified rows are staged.

    Write the result before it is filtered, as runs do: conditions on it are otherwise carried through all of its expressions.
    """
    require_types(transactions)
    limits = config.audit
    rows = with_results(description_context(stage(classified(audit_history(transactions, run_date), config), "classified")), rules(config), config)
    return concluded(rows).select(
        *COLUMNS, F.lit(run_date).cast("date").alias("run_date"), F.lit(limits.reference_mode).alias("reference_mode"), F.lit(limits.z_threshold).alias("z_threshold"), F.lit(limits.min_samples).alias("min_samples"),
        "line_value", "record_type", "channel", "has_dotcom_postage", "data_quality_flags", "context_flags", "check_results",
        "data_anomaly_flags", "business_anomaly_flags", "anomaly_flags", "max_severity", "assessment_status",
    )


def exploded(audited: DataFrame, *keep: str) -> DataFrame:
    """One row for each check."""
    return audited.select(*keep, F.explode("check_results").alias("__c")).select(*keep, "__c.*")


def multiset_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that a and b don't hold equally often, with surplus (positive: more in a). One shuffle; nulls and NaN are equal to themselves."""
    columns = a.columns
    signed = a.select(*columns, F.lit(1).alias("__n")).unionAll(b.select(*columns, F.lit(-1).alias("__n")))
    return signed.groupBy(*columns).agg(F.sum("__n").alias("surplus")).where("surplus != 0")


def require_audit_contract(audited: DataFrame, transactions: DataFrame, run_date: str) -> None:
    """The audit holds exactly its input's rows, for this day, with the rules in order, their tiers, known types and channels, and consistent statuses."""
    if not multiset_difference(audited.select(*COLUMNS), audit_history(transactions, run_date).select(*COLUMNS)).isEmpty():
        raise ContractError("the audit doesn't hold its input's rows")
    in_order = lambda field, values: F.transform("check_results", lambda c: c[field]) == F.array(*map(F.lit, values))
    one_of = lambda column, values: F.col(column).isin(*values)
    named = lambda tier: F.transform(F.filter("check_results", lambda c: (c["status"] == "flagged") & (c["tier"] == tier)), lambda c: c["rule"])
    conditions = [
        F.col("run_date") == F.lit(run_date).cast("date"), in_order("rule", RULES), in_order("tier", TIERS.values()), one_of("record_type", RECORD_TYPES), one_of("channel", CHANNELS),
        F.forall("check_results", lambda c: c["status"].isin("flagged", "not_flagged", "not_applied") & (c["severity"].isNotNull() == (c["status"] == "flagged")) & (c["reason"].isNotNull() == (c["status"] == "not_applied"))),
        F.col("data_anomaly_flags") == named("data"), F.col("business_anomaly_flags") == named("business"), F.col("anomaly_flags") == F.concat("data_anomaly_flags", "business_anomaly_flags"),
        (F.size("anomaly_flags") > 0) == (F.col("assessment_status") == "flagged"), F.col("max_severity").isNotNull() == (F.col("assessment_status") == "flagged"),
        *[F.col(c).isNotNull() for c in ("reference_mode", "z_threshold", "min_samples", "data_quality_flags", "context_flags", "has_dotcom_postage")],
    ]
    broken = [r for r in audited.agg(*[F.count_if(~truth(c)).alias(f"c{i}") for i, c in enumerate(conditions)]).first()]
    if any(broken):
        raise ContractError(f"checks are out of order or inconsistent: rows that break each condition: {broken}")
