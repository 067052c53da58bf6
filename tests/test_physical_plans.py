"""Shape of the physical plans: shuffles, scans, no Python where none is needed."""

import re

import pytest

from loanloom.catalog import QUERIES
from loanloom.operators import aggregates as A
from loanloom.operators import evaluate as E
from loanloom.operators import sampling
from loanloom.plans.spine import build_spine


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def static_plans(spark):
    """Plans as they are without broadcasts and without re-planning."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.adaptive.enabled", "true")


def shuffles(plan):
    return len(re.findall(r"Exchange hashpartitioning", plan))


def test_each_table_of_the_spine_is_shuffled_once(tables, static_plans):
    views = tables.loan_tables()
    small = {n: views[n] for n in ("app", "previous_application", "pos_cash", "credit_card")}
    assert shuffles(plan_of(build_spine(small).table)) == 4


def test_client_aggregate_combines_before_the_shuffle(tables, static_plans):
    plan = plan_of(A.aggregate_installments(tables.view("installments_payments")))
    assert "partial_" in plan


def test_bureau_without_balance_columns_does_not_read_the_balance(tables):
    plan = plan_of(
        A.aggregate_bureau(tables.view("bureau"), tables.view("bureau_balance"), ["AMT_CREDIT_SUM"])
    )
    assert "lineitem" not in plan


def test_scan_reads_only_needed_columns(tables):
    plan = plan_of(E.threshold_curve(tables.scored))
    read = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    assert read and all("value" not in r and "user_id" not in r for r in read)


def test_filter_reaches_the_scan(tables):
    plan = plan_of(tables.view("credit_card"))
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,purchase)]" in plan


def test_sweep_has_two_small_shuffles(tables, static_plans):
    plan = plan_of(E.threshold_curve(tables.scored))
    assert "Window" not in plan and "Join" not in plan


def test_sample_does_not_shuffle_the_rows(tables, static_plans):
    plan = plan_of(sampling.sample_fraction(tables.app, "SK_ID_CURR", 0.3))
    main = plan.split("Subquery")[0] if plan.index("Subquery") > 0 else plan
    assert "Exchange" not in main


PYTHON_ALLOWED = {
    "m13_tree_contributions",
    "m15_tree_contribution_summary",
    "m13_shapley_contributions",
    "m15_shapley_summary",
}
LONG_RUNNING = ("m7", "m8", "m9", "m12", "m16", "r1", "r2", "r3", "s")


@pytest.mark.parametrize(
    "name",
    [n for n in sorted(QUERIES) if n not in PYTHON_ALLOWED and not n.startswith(LONG_RUNNING)],
)
def test_no_python_and_no_cross_product(spark, folder, name):
    plan = plan_of(QUERIES[name](spark, folder))
    assert "ArrowEvalPython" not in plan and "BatchEvalPython" not in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
