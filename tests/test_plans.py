"""Physical plans: no nested-loop joins, single-task windows only over summaries, early limits and pruned scans."""

import re

import plans
import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from marketloom.operators import cleaning, statistics
from marketloom.operators.ordering import top_per_key
from marketloom.queries import QUERIES

@pytest.mark.parametrize("name", ["A11_score_distribution", "A16_outliers", "A31_five_number_summary", "A10_feature_statistics"])
def test_distributions_count_values_once(spark, monkeypatch, name):
    """The rows are read by one count of distinct values; all else reads what that has written."""
    calls = []
    count = statistics.counted
    monkeypatch.setattr(statistics, "counted", lambda *a, **b: calls.append(1) or count(*a, **b))
    assert "FileScan" not in plans.plan_of(QUERIES[name](spark, SMALL)) and len(calls) == 1


def test_cleaning_audit_reads_the_corpus_once(spark):
    plan = plans.plan_of(QUERIES["A22_cleaning_audit"](spark, SMALL))
    assert plan.count("FileScan parquet") == 1 and "Join" not in plan


def test_top_k_is_cut_before_the_shuffle(tables):
    long = cleaning.unpivot(tables.scored, ["doc_id"], ["supply", "demand"], name="dim")
    plan = plans.plan_of(top_per_key(long, ["dim"], [F.desc("value"), F.asc("doc_id")], 5))
    assert plan.count("WindowGroupLimit") == 2 and "Partial" in plan


def test_scans_are_pruned_and_filtered(spark):
    plan = plans.plan_of(QUERIES["S05_panel_scan"](spark, SMALL))
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual(o_orderdate" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double,o_orderdate:timestamp" in plan


def test_window_stack_shares_one_exchange_by_series(tables):
    from marketloom.operators import series

    w = series.ordered(["market"])
    df = tables.px.select("market", "date", series.band_width("close", w).alias("b"), series.log_return("close", w).alias("r"), series.cross_signal("close", w).alias("s"))
    plan = plans.plan_of(df)
    assert len(re.findall(r"Exchange hashpartitioning\(market#\d+, \d+\)", plan)) == 1
