"""Every registered query of the engine against its SQL twin on the smallest tables, where both are at hand."""

import os

import duckdb
import pytest

from granary import plans

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events".split()
#: One of each kind; TEST_ALL_QUERIES=1 takes all.
FEW = ["clean_counts", "rfm_scores", "rfm_scores_at_scale", "state_advance", "novel_rows", "record_types", "keyword_context", "baseline_channel_stock", "rule_quantity_deviation", "rule_unmatched_return", "row_status", "order_assessments", "report_rules", "evidence_crosstab", "revenue_by_month", "iqr_fences", "event_sessions"]
NAMES = sorted(plans.oracle_sql()) if os.environ.get("TEST_ALL_QUERIES") else FEW


def plain(rows):
    number = lambda v: float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    return sorted((tuple(number(v) for v in r) for r in rows), key=repr)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    frame = plans.queries()[name](spark, DATA)
    columns = sorted(frame.columns)
    found = db.sql(plans.oracle_sql()[name])
    assert sorted(found.columns) == columns
    want = [[row[found.columns.index(c)] for c in columns] for row in found.fetchall()]
    assert plain(frame.select(*columns).collect()) == plain(want)
