"""Relations between reports that hold for any ledger."""

import pytest

from ledgerlens import reports
from ledgerlens.sources import testbed

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def result(spark):
    ledger = testbed.event_ledger(spark, SF_DIR).cache()
    accounts = testbed.accounts(spark, SF_DIR).cache()
    kept = {}

    def get(name):
        if name not in kept:
            kept[name] = [r.asDict() for r in reports.run(name, ledger, accounts).collect()]
        return kept[name]

    return get


def total(rows, column):
    return sum(r[column] for r in rows)


@pytest.mark.parametrize(
    ("name", "share"),
    [
        ("status_share", "pct_of_txns"),
        ("value_deciles", "pct_of_total_value"),
        ("value_decile_share_all", "share_pct"),
        ("value_tiers", "pct_of_value"),
        ("account_status_exposure", "pct_of_value"),
        ("failure_distribution", "pct_customers"),
        ("rfm_segment_summary", "pct_customers"),
        ("pending_age", "pct_of_pending"),
    ],
)
def test_shares_add_up(result, name, share):
    rows = result(name)
    assert total(rows, share) == pytest.approx(100, abs=0.06 * len(rows))


@pytest.mark.parametrize(
    "name",
    ["status_share", "channel_rates", "review_rate_by_type", "international_profile", "review_rate_by_amount_band",
     "monthly_activity", "time_of_day_rates", "gap_since_previous", "monthly_trend", "account_status_activity"],
)
def test_groups_partition_the_ledger(result, name):
    assert total(result(name), "txn_count") == result("kpi_summary")[0]["total_transactions"]


def test_kpis_agree_with_the_detail(result):
    kpis = result("kpi_summary")[0]
    ok = next(r for r in result("status_share") if r["status"] == "Successful")
    assert kpis["success_rate_pct"] == ok["pct_of_txns"]
    assert kpis["successful_value"] == ok["total_value"] == total(result("type_value_skew"), "total_value")
    assert kpis["successful_value"] == total(result("value_deciles"), "total_value")
    assert kpis["successful_value"] == total(result("value_tiers"), "total_value")


def test_decile_sizes_differ_by_one_at_most(result):
    sizes = [r["customers"] for r in result("value_deciles")]
    assert max(sizes) - min(sizes) <= 1 and sizes == sorted(sizes, reverse=True)


def test_deciles_fall(result):
    shares = [r["pct_of_total_value"] / r["customers"] for r in result("value_deciles")]
    assert shares == sorted(shares, reverse=True)


def test_wider_rules_recall_more(result):
    rows = result("rule_scorecard")
    assert [r["recall_pct"] for r in rows] == sorted(r["recall_pct"] for r in rows)
    assert [r["txns_selected"] for r in rows] == sorted(r["txns_selected"] for r in rows)


def test_failures_add_up(result):
    failed = next(r for r in result("status_share") if r["status"] == "Failed")
    assert total(result("failure_distribution"), "failed_txns_total") == failed["txn_count"]


def test_curve_and_summary_agree(result):
    curve = sorted(result("cumulative_value_curve"), key=lambda r: r["customer_rank"])
    values = [r["cumulative_value_pct"] for r in curve]
    assert values == sorted(values) and values[-1] == 100.0
    assert total(result("expected_counts"), "observed") == result("kpi_summary")[0]["total_transactions"]
