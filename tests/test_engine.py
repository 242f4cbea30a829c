"""Literal-row tests of the boundary rules, contract refusals, and equivalences."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from granary.functions.exprs import compact_flags, finite, normalized
from granary.operators import audit, baselines, clean, orders, publish, reports, rfm, store
from granary.schema import COLUMNS, TRANSACTION, ContractError, require_types
from granary.sources import landing, readers, storage

DAY = datetime(2011, 3, 1, 10)


def frame(spark, *rows):
    """Rows of (invoice, stock, description, quantity, price, customer) with defaults for date and country, or all eight columns."""
    full = [r if len(r) == 8 else (r[0], r[1], r[2], r[3], DAY, r[4], r[5], "UK") for r in rows]
    return spark.createDataFrame(full, TRANSACTION)


# ---------------------------------------------------------------------------------------------- expressions and cleaning


def test_expressions(spark):
    df = spark.createDataFrame([(" a  b ", 1.0), ("  ", float("nan")), (None, float("inf")), ("x", None)], "s string, x double")
    found = df.select(normalized(F.col("s")).alias("n"), normalized(F.col("s"), True).alias("c"), finite(F.col("x")).alias("f"), compact_flags([("big", F.col("x") > 0), ("none", F.col("x").isNull())]).alias("flags")).collect()
    assert [(r.n, r.c, r.f) for r in found] == [("A  B", "A B", True), (None, None, False), (None, None, False), ("X", "X", False)]
    assert found[3].flags == ["none"]


def test_cleaning_policies(spark):
    df = frame(spark, ("1", "P1", "MUG", 2, 1.5, "7"), ("1", "P1", "MUG", 2, 1.5, "7"), ("c9", "P1", "MUG", 2, 1.5, "7"), ("2", "post ", "X", 1, 1.0, "7"), ("3", "P2", " packing charge", 1, 1.0, "7"), ("4", "P2", "MUG", -1, 1.0, "7"), ("5", "P2", "MUG", 1, 0.0, "7"), ("6", "P2", None, 1, 1.0, "7"), ("7", "P2", "MUG", 1, float("inf"), "7"), ("8", "P2", "MUG", 1, 2.0, " "))
    metrics, distinct = clean.prepared(df)
    assert distinct.count() == 9
    assert sorted(r.InvoiceNo for r in metrics.collect()) == ["1", "7", "8"]
    assert [r.InvoiceNo for r in clean.daily_policy(distinct).collect()] == ["1"]


def test_cutoffs(spark):
    df = spark.createDataFrame([("1", "P", "d", 1, t, 1.0, "c", "UK") for t in (datetime(2011, 3, 1), datetime(2011, 2, 28, 23, 59), None)], TRANSACTION)
    assert clean.metrics_history(df, "2011-03-01").count() == 1 and clean.audit_history(df, "2011-03-01").count() == 2
    with pytest.raises(ContractError):
        clean.require_before(df, "2011-03-01")
    with pytest.raises(ContractError):
        clean.require_metrics_contract(df)
    with pytest.raises(ContractError):
        require_types(df.withColumn("Quantity", F.col("Quantity").cast("long")))


# ---------------------------------------------------------------------------------------------- customers


def test_metrics_round_the_sum_half_up(spark):
    df = frame(spark, ("1", "P", "d", 1, 0.0025, "a"), ("2", "P", "d", 1, 0.0025, "a"), ("2", "P", "d", 3, 1.00004, "b"))
    found = {r.CustomerID: r for r in rfm.metrics(df, "2011-03-02").collect()}
    assert str(found["a"].Monetary) == "0.01" and found["a"].Frequency == 2 and found["a"].Recency == 1
    assert str(found["b"].Monetary) == "3.00"


@pytest.mark.parametrize("at_scale", [False, True])
def test_scores_keep_ties(spark, at_scale):
    df = spark.createDataFrame([(str(i), 10 * i + 1, 1, float(i)) for i in range(6)], "CustomerID string, Recency int, Frequency int, Monetary double")
    found = {r.CustomerID: r for r in rfm.scores(df, at_scale=at_scale).collect()}
    assert [found[str(i)].M_score for i in range(6)] == [1, 2, 3, 4, 5, 5] and [found[str(i)].R_score for i in range(6)] == [5, 5, 4, 3, 2, 1]
    assert {r.F_score for r in found.values()} == {1} and found["0"].RFM_score == "511"
    assert rfm.scores(df.limit(1), at_scale=at_scale).first().M_score == 1


def test_labels(spark):
    df = spark.createDataFrame([("a", 90, 5, 5, 5), ("b", 89, 4, 4, 4), ("c", 90, 1, 1, 1), ("d", 5, 4, 2, 3), ("e", 5, 3, 3, 3)], "CustomerID string, Recency int, R_score int, F_score int, M_score int")
    assert [r.segment for r in rfm.labels(df, 365).orderBy("CustomerID").collect()] == ["high_value_inactive", "high_value_active", "inactive", "recent_low_frequency", "regular"]
    assert {r.churn_assessment_status for r in rfm.labels(df, 89).collect()} == {"insufficient_history"}
    with pytest.raises(ContractError):
        rfm.log_features(spark.createDataFrame([(0, 1, 1.0)], "Recency int, Frequency int, Monetary double"))


# ---------------------------------------------------------------------------------------------- audit


def rules(audited):
    return {r.InvoiceNo or "-": set(r.anomaly_flags) for r in audited.collect()}


def test_baseline_is_the_median_and_its_deviation(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 4.0), ("a", 10.0), ("b", 5.0), ("b", 5.0), (None, 1.0), ("c", None), ("c", float("nan"))], "k string, v double")
    found = {r.k: (r.x_n, r.x_med, r.x_mad) for r in baselines.robust_baseline(df, ["k"], F.col("v"), "x").collect()}
    assert found == {"a": (4, 3.0, 1.5), "b": (2, 5.0, 0.0)}


def test_data_rules(spark):
    df = frame(
        spark, ("1", "P", "d", 1, 1.0, "a"), ("2", "P", None, 1, 1.0, "a"), ("C3", "P", "d", 1, 1.0, "a"), ("4", "P", "d", -1, 1.0, "a"), ("5", "P", "d", 1, -1.0, "a"), ("A6", "B", "d", 1, -1.0, None),
        ("7", "P", "d", 1, 1.0, "a"), ("7", "P", "d", 1, 1.0, "b"), ("8", "P", "d", 1, 1.0, "a"), ("8", "P", "d", 1, 1.0, None), (None, "P", "d", 1, 1.0, "a"), ("9", "P", "d", 1, float("nan"), "a"),
        ("10", "P", "d", 1, DAY, 1.0, "a", "UK"), ("10", "P", "d", 1, DAY, 1.0, "a", "FR"),
    )
    found = rules(audit.audit(df, "2012-01-01"))
    assert found["1"] == set() and found["2"] == {"missing_description"} and found["C3"] == {"cancel_sign_conflict"} and found["4"] == {"cancel_sign_conflict"}
    assert found["5"] == {"negative_price_outside_adjustment"} and found["A6"] == {"manual_accounting_entry"} and found["7"] == {"invoice_multiple_customers"} and found["8"] == set()
    assert found["-"] == {"missing_required_field"} and found["9"] == {"invalid_numeric_value"} and found["10"] == {"invoice_inconsistent_header"}


def test_deviation_levels_and_materiality(spark):
    usual = [(str(i), "P1", "d", 10 + i % 3, 2.0, "a") for i in range(8)]
    odd = [("90", "P1", "d", 200, 2.0, "a"), ("91", "P1", "d", 10, 9.0, "a"), ("92", "P1", "d", 14, 2.0, "a")]
    checks = audit.exploded(audit.audit(frame(spark, *usual, *odd), "2012-01-01"), "InvoiceNo")
    found = {(r.InvoiceNo, r.rule): r for r in checks.where("rule like '%deviation'").collect()}
    big, dear = found["90", "quantity_deviation"], found["91", "price_deviation"]
    assert big.status == "flagged" and big.context_level == "customer_stock" and big.severity == "medium"
    assert dear.status == "flagged" and dear.robust_z is None and dear.reference_mad == 0.0
    assert found["92", "quantity_deviation"].status == "not_flagged"  # odd, but less than threefold
    alone = audit.exploded(audit.audit(frame(spark, ("1", "P1", "d", 1, 1.0, "a")), "2012-01-01"), "InvoiceNo").where("rule = 'quantity_deviation'").first()
    assert alone.reason == "insufficient_history" and alone.observed_value == 1.0 and alone.reference_median is None


def test_operational_rules(spark):
    later = datetime(2011, 6, 1)
    df = frame(
        spark, ("1", "P1", "d", 5, 0.0, "a"), ("1", "P1", "d", 5, 2.0, "a"), ("2", "P1", "d", 5, 0.0, "a"), ("3", "P1", "d", -9, 0.0, None), ("A4", "B", "d", 1, -5000.0, None),
        ("C5", "P1", "d", -50, later, 2.0, "a", "UK"), ("C6", "P1", "d", -1, later, 2.0, None, "UK"), ("C7", "P1", "d", -50, DAY, 2.0, "b", "UK"),
    )
    audited = audit.audit(df, "2012-01-01")
    found = rules(audited)
    assert found["2"] == {"all_zero_price_invoice"} and found["3"] == {"inventory_adjustment"} and found["C5"] == {"unmatched_return"} and found["C6"] == set() and found["C7"] == set()
    severities = {r.InvoiceNo: r.max_severity for r in audited.collect()}
    assert severities["A4"] == "high"
    audit.require_audit_contract(audited, df, "2012-01-01")
    with pytest.raises(ContractError):
        audit.require_audit_contract(audited, df.limit(3), "2012-01-01")


def test_orders(spark):
    usual = [(f"{i}", "P", "d", 10, 2.0 + i % 2, "a") for i in range(6)]
    df = frame(spark, *usual, ("50", "P", "d", 900, 2.0, "a"), ("C1", "P", "d", -1, 2.0, "a"), ("60", "P", "d", 0, 2.0, "a"), ("70", "P", "d", 1, 2.0, "x"), ("70", "P", "d", 1, 2.0, "y"), ("80", "P", "d", 1, 2.0, None))
    found = {r.invoice_key: r for r in orders.assess_orders(df, "2012-01-01").collect()}
    assert found["50"].status == "flagged" and found["50"].context_level == "customer" and found["0"].status == "not_flagged"
    assert [found[k].reason for k in ("C1", "60", "70", "80")] == ["cancelled_invoice", "invalid_invoice_lines", "multiple_customer_ids", "insufficient_history"]


def test_class_metrics(spark):
    cells = spark.createDataFrame([(0, 0, 8), (0, 1, 2), (1, 1, 5), (2, 1, 5)], "label int, predicted int, n long")
    found = {r.label: (r.precision, r.recall, r.f1) for r in reports.class_metrics(cells).collect()}
    assert found[0] == (1.0, 0.8, pytest.approx(16 / 18)) and found[2] == (0.0, 0.0, 0.0)


# ---------------------------------------------------------------------------------------------- sources


HEADER = ",".join(COLUMNS)


def test_landing_roundtrip_and_quarantine(spark, tmp_path):
    source = tmp_path / "source.csv"
    source.write_bytes((HEADER + '\n1,P1,"caf\xe9, ""big""\nmug",2,1/2/2011 8:05,1.5,7,UK\n2,P2,x,two,1/4/2011 9:00,NaN,,UK\n3,P3,y,1,not a date,2,8,UK\n').encode("cp1252"))
    manifest = landing.split(spark, str(source), str(tmp_path / "root"), "v1")
    assert manifest["partitions"]["2011-01-03"] == {"path": None, "rows": 0} and manifest["undated"]["rows"] == 1 and manifest["rows"] == 3
    assert landing.split(spark, str(source), str(tmp_path / "root"), "v1") == manifest
    typed, rejected = landing.read_landing(spark, str(tmp_path / "root"), "v1", "2011-01-04")
    rows = {r.InvoiceNo: r for r in typed.collect()}
    assert rows["1"].Description == 'café, "big"\nmug' and rows["1"].InvoiceDate == datetime(2011, 1, 2, 8, 5) and rows["2"].Quantity is None
    assert {r.InvoiceNo: r.raw_Quantity for r in rejected.collect()} == {"2": "two", "3": "1"}
    assert landing.read_landing(spark, str(tmp_path / "root"), "v1", "2011-01-03")[0].count() == 2
    with pytest.raises(ContractError):
        landing.validated(spark, str(tmp_path / "root"), "v1", "2011-02-01")
    source.write_text(HEADER + "\n1,P1,x,2,1/2/2011 8:05,1.5,7,UK\n")
    with pytest.raises(ContractError):
        landing.split(spark, str(source), str(tmp_path / "root"), "v1")


def test_typed_csv(spark, tmp_path):
    (tmp_path / "t.csv").write_text(HEADER + "\n1,P1,x,2,1/2/2011 8:05,1.5,NaN,UK\n2,P1,x,bad,1/2/2011 8:05,1.5,5,UK\n")
    rows = {r.InvoiceNo: r for r in readers.typed_csv(spark, str(tmp_path / "t.csv")).collect()}
    assert rows["1"].CustomerID is None and rows["2"].Quantity is None and rows["2"].CustomerID == "5"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, date(2011, 1, 1)), (2, date(2011, 1, 2))], "x int, run_date date")
    storage.replace_partitions(df, f"{tmp_path}/p")
    storage.replace_partitions(df.where("x = 2").withColumn("x", F.lit(9)), f"{tmp_path}/p")
    assert sorted(r.x for r in spark.read.parquet(f"{tmp_path}/p").collect()) == [1, 9]
    assert storage.write_immutable(df, f"{tmp_path}/i") and not storage.write_immutable(df, f"{tmp_path}/i")
    with pytest.raises(FileExistsError):
        storage.write_immutable(df.limit(1), f"{tmp_path}/i")
    files = storage.Files(spark, str(tmp_path))
    files.write_json(f"{tmp_path}/a.json", {"é": [1]})
    assert files.read_json(f"{tmp_path}/a.json") == {"é": [1]}
    with pytest.raises(FileExistsError):
        files.write_json(f"{tmp_path}/a.json", {})
    with files.lock(), pytest.raises(RuntimeError), files.lock():
        pass
    with pytest.raises(ValueError):
        storage.separate("/a/b", "/a/b/c")


# ---------------------------------------------------------------------------------------------- store, stream, runs


def test_store_takes_each_batch_once(spark, tmp_path):
    kept = store.Store(spark, str(tmp_path / "store"))
    first = frame(spark, ("1", "P", "d", 1, 1.005, "a"), ("2", "P", "d", 2, 2.0, "b"))
    second = frame(spark, ("1", "P", "d", 1, 1.005, "a"), ("1", "Q", "d", 1, 3.0, "a"), ("3", "P", None, 1, 4.0, "c"))
    with pytest.raises(ValueError):
        kept.ingest(first, "one", "2011-04-01")
    kept.ingest(first, "one", "2011-04-01", initialize=True, buckets=2)
    manifest = kept.ingest(second, "two", "2011-04-01")
    assert kept.ingest(second, "two", "2011-04-01") == manifest and kept.versions() == ["000000000001", "000000000002"]
    kept.ingest(second, "again", "2011-04-02")
    every = first.unionAll(second).distinct()
    same = lambda s: sorted(map(str, s.select("CustomerID", "LastPurchaseDate", "Frequency", "MonetaryTotal").collect()))
    assert same(kept.read("state")) == same(store.customer_state(every))
    assert kept.read("transactions").count() == 4
    assert kept.manifest(run_date="2011-04-01")["version"] == "000000000002"
    for batch, name, day in ((first, "two", "2011-04-02"), (second, "three", "2011-03-31"), (second.withColumn("batch_id", F.lit(1)), "four", "2011-04-03")):
        with pytest.raises(ContractError):
            kept.ingest(batch, name, day)
    metrics = {r.CustomerID: r for r in store.metrics_of(kept.read("state"), "2011-04-01").collect()}
    assert str(metrics["a"].Monetary) == "4.01" and metrics["a"].Recency == 31


def test_fingerprint_ignores_order_only(spark):
    df = frame(spark, ("1", "P", "d", 1, 1.0, "a"), ("2", "P", None, 2, 2.0, "b"))
    assert store.fingerprint(df) == store.fingerprint(df.orderBy(F.desc("InvoiceNo")).select(*reversed(COLUMNS)))
    assert store.fingerprint(df) != store.fingerprint(df.unionAll(df.limit(1)))


def test_stream_feeds_the_store(spark, tmp_path):
    from granary import streaming

    frame(spark, ("1", "P", "d", 1, 1.0, "a"), ("2", "P", "d", 2, 2.0, "b")).write.parquet(f"{tmp_path}/in")
    kept = store.Store(spark, str(tmp_path / "store"))
    for _ in range(2):
        streaming.into_store(streaming.landed(spark, f"{tmp_path}/in"), kept, "s", f"{tmp_path}/check", "2011-04-01").awaitTermination()
    assert kept.read("state").count() == 2 and len(kept.versions()) == 1


def test_daily_run_end_to_end(spark, tmp_path):
    rng_rows = [f"{i},P{i % 4},item {i % 4},{1 + i % 5},1/{1 + i % 28}/2011 8:05,{1 + i % 7}.5,{i % 12},UK" for i in range(200)]
    source = tmp_path / "source.csv"
    source.write_text(HEADER + "\n" + "\n".join(rng_rows) + "\n")
    root = str(tmp_path / "root")
    landing.split(spark, str(source), root, "v1")
    work = publish.Workspace(spark, root)
    base = work.context("retail", "bootstrap", "2011-01-20", "v1", kind="bootstrap")
    work.run_etl(base)
    work.train(base, 2, "model1")
    work.activate("model1", "2011-01-21")
    context = work.context("retail", "day", "2011-01-28", "v1")
    assert work.context("retail", "day", "2011-01-28", "v1") == context
    with pytest.raises(ContractError):
        work.context("retail", "day", "2011-01-27", "v1")
    published = work.daily(context)
    assert work.verify_snapshot("2011-01-29") == published and work.publish_branch(context, "rfm")["complete"]
    assert spark.read.parquet(published["stages"]["rfm"]["outputs"]["customers"]).count() == 12
    assert published["stages"]["etl"]["counts"]["input"] == 200
    with pytest.raises(LookupError):
        work.resolve("2011-01-01")
    assert publish.training_dates("2011-12-10")["train"] == "2011-09-11"
