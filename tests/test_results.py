"""Every registered query equals its SQL."""

import check_results
import pytest

import __spark_entry__ as entry

CHECKED = sorted(entry.oracle_sql())
# many boosted fits; tests/test_models.py covers them on a small table
SLOW = {"m8_train_and_evaluate", "m9_cross_validation"}
UNCHECKED = sorted(set(entry.queries()) - set(CHECKED) - SLOW)


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, sql_engine, folder, name):
    _, _, verdict = check_results.check(spark, sql_engine, name, folder)
    assert verdict == "ok"


@pytest.mark.parametrize("name", UNCHECKED)
def test_query_without_sql_gives_rows(spark, folder, name):
    assert entry.queries()[name](spark, folder).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_is_the_wide_table(spark):
    df = entry.entry(spark)
    assert len(df.columns) > 100
    assert {"SK_ID_CURR", "split", "EXT_SOURCE_MEAN", "INST_LATE_PAYMENT_SUM"} <= set(df.columns)
