"""What queries over checked rows leave on disk: no more than they tell, and no shuffle that has served."""

import os

import pytest

from granary.operators import audit, clean
from granary.plans import engine, retail
from granary.sources import staging

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
NAMES = [
    "row_status",
    "price_deviation_by_part",
    "price_deviation_by_type",
    "quantity_deviation_by_part",
    "quantity_deviation_by_type",
    "flag_cooccurrence",
    "report_baseline_levels",
    "report_fold_percentiles",
    "report_not_applied",
    "report_price_direction",
    "report_rules",
    "report_rules_by_channel",
    "report_status_severity",
    "report_top3_per_rule",
]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", NAMES)
def test_no_whole_audit_is_staged(spark, monkeypatch, name):
    staged = []
    for module in (audit, retail):
        monkeypatch.setattr(module, "stage", lambda df, tag: staged.append((tag, df.columns)) or staging.stage(df, tag))
    from granary import plans

    plans.queries()[name](spark, DATA)
    assert staged and not any({"Description", "check_results", "data_quality_flags"} & set(columns) for _, columns in staged)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_parts_hold_every_row_once_and_tell_what_the_audit_tells(spark):
    told = ["InvoiceNo", "StockCode", "Quantity", "max_severity", "assessment_status", "anomaly_flags"]
    history = clean.audit_history(retail.retail_view(spark, DATA), retail.RUN_DATE)
    facts = audit.facts(history, audit.rules(), *told[:3])
    found = [r for part in audit.parts(facts, audit.rules()) for r in audit.concluded(part).select(told).collect()]
    assert sorted(map(repr, found)) == sorted(map(repr, audit.audit(history, retail.RUN_DATE).select(told).collect()))


def test_the_shuffles_of_a_staged_table_end_with_it(spark):
    blocks = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().size()
    before = blocks()
    staging.stage(spark.range(1000).selectExpr("id % 7 k").groupBy("k").count(), "counts")
    assert blocks() <= before


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_student_reads_its_metrics_once(spark, monkeypatch):
    staged = []
    monkeypatch.setattr(engine, "stage", lambda df, tag: staged.append(tag) or staging.stage(df, tag))
    plan = engine.student_scores(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert staged == ["rfm"] and "lineitem" not in plan and "l_orderkey" not in plan
