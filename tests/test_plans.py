"""Physical plans: what is scanned, shuffled and joined."""

import re

import pytest

import __spark_entry__ as contract
from ledgerlens import reports
from ledgerlens.sources import ledger as tables
from ledgerlens.sources import testbed

SF_DIR = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """The ledger as it would lie on storage, so that pruning and pushdown show in the scan."""
    path = str(tmp_path_factory.mktemp("plans") / "ledger")
    tables.save_by_month(testbed.event_ledger(spark, SF_DIR), path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def accounts(spark):
    return testbed.accounts(spark, SF_DIR)


def report_plan(name, stored, accounts) -> str:
    return plan_of(reports.run(name, stored, accounts))


@pytest.mark.parametrize("name", [n for n in contract.ledger_queries() if not n.endswith(contract.SPREAD_SUFFIX)])
def test_no_cross_join_and_no_python_evaluation(spark, name):
    plan = plan_of(contract.queries()[name](spark, SF_DIR))
    assert not re.search("NestedLoop|Cartesian|EvalPython|InPandas|MapInArrow", plan)


@pytest.mark.parametrize("name", reports.RANKED)
def test_spread_windows_over_rows_are_partitioned(name, stored, accounts):
    plan = report_plan(name, stored, accounts)
    for window in re.findall(r"row_number\(\) windowspecdefinition\(([^)]*)", plan):
        assert "_bucket" in window or window.startswith("customer_id")  # copies of one customer
    for window in re.findall(r"windowspecdefinition\(([^)]*)specifiedwindowframe\(RowFrame, unboundedpreceding\$\(\), currentrow", plan):
        assert "_bucket" in window or window.startswith("customer_id")


def test_tiers_count_bins_before_the_shuffle(stored, accounts):
    """Rows are combined by bin first; rows themselves move only where a cut divides a bin."""
    plan = report_plan("value_tiers", stored, accounts)
    assert re.search(r"HashAggregate\(keys=\[bin#", plan)
    assert "BroadcastHashJoin" in plan and "SortAggregate" not in plan


def test_rank_lookup_reads_the_ledger_once(stored, accounts):
    df = reports.run("value_deciles", stored, accounts)
    df.collect()
    final = plan_of(df)
    assert final.count("ReusedExchange") >= 3


def test_column_pruning_and_pushdown(stored, accounts):
    plan = report_plan("type_value_skew", stored, accounts)
    schema = re.search(r"ReadSchema: struct<([^>]*)>", plan).group(1)
    assert {c.split(":")[0] for c in schema.split(",")} == {"txn_type", "amount", "status"}
    assert "EqualTo(status,Successful)" in plan


def test_relationship_check_is_one_outer_join(stored, accounts):
    plan = report_plan("relationship_check", stored, accounts)
    assert plan.count("FullOuter") == 1 and plan.count("FileScan") == 2


@pytest.mark.parametrize("name", ["rule_scorecard", "two_proportion_ztest", "status_share", "monthly_activity"])
def test_single_pass(name, stored, accounts):
    assert report_plan(name, stored, accounts).count("FileScan") == 1


@pytest.mark.parametrize(
    "name", ["segment_behaviour", "account_status_activity", "preferred_channel_match", "account_status_exposure"]
)
def test_ledger_is_aggregated_before_the_join(name, stored, accounts):
    plan = report_plan(name, stored, accounts)
    below_join = plan[plan.index("Join") :]
    assert "HashAggregate(keys=[customer_id" in below_join


def test_gap_report_combines_minutes_before_the_shuffle(stored, accounts):
    """Windows run over a customer's minutes of a day and over its days, never over rows of the ledger."""
    plan = report_plan("gap_since_previous", stored, accounts)
    assert re.search(r"lag\(minute#\d+L?, -1, null\) windowspecdefinition\(customer_id#\d+L?, day", plan)
    assert re.search(r"lag\(last#\d+L?, -1, null\) windowspecdefinition\(customer_id#\d+L?, day", plan)
    below_first_shuffle = plan[plan.rindex("Exchange hashpartitioning") :]
    assert "partial_min" in below_first_shuffle and "partial_count" in below_first_shuffle
    assert plan.count("FileScan") == 1
