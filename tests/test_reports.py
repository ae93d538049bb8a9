"""Reports on hand-written ledgers: empty input, single rows, empty groups, missing keys."""

import datetime as dt

import pytest

from ledgerlens import reports
from ledgerlens.operators import concentration, customers, kpi, profiling, rates, rfm, rules, sequence, statistics

DAY = dt.datetime(2026, 2, 1, 9, 0)
ACCOUNT = (1, "SME", "Active", "Web")


def rows(df):
    return [r.asDict() for r in df.collect()]


@pytest.mark.parametrize("name", list(reports.REPORTS))
def test_empty_ledger(name, ledger_of, accounts_of):
    filled, one_account = ledger_of({}), accounts_of(ACCOUNT)
    expected = reports.run(name, filled, one_account).columns
    got = reports.run(name, ledger_of({}).limit(0), one_account.limit(0))
    assert got.columns == expected
    assert len(got.collect()) <= 60


def test_one_customer_one_transaction(ledger_of, accounts_of):
    ledger, accounts = ledger_of({"amount": 250.0}), accounts_of(ACCOUNT)

    def run(name):
        return rows(reports.run(name, ledger, accounts))

    assert run("value_deciles") == [{"decile": 1, "customers": 1, "total_value": 250.0, "pct_of_total_value": 100.0}]
    assert [(r["r_score"], r["f_score"], r["m_score"]) for r in run("customer_rfm")] == [(1, 1, 1)]
    outliers = run("amount_outliers")[0]
    assert (outliers["median"], outliers["skewness"], outliers["outliers"]) == (250.0, None, 0)
    amount = next(r for r in run("profile_describe_transactions") if r["column_name"] == "amount")
    assert (amount["count"], amount["std"], amount["p25"]) == (1, None, 250.0)
    assert [r["mom_growth"] for r in run("monthly_trend")] == [None]
    assert run("gap_since_previous")[0]["gap_since_previous"] == "0: first transaction"
    # Half of one customer is no customer: the whole value counts as the lower part.
    assert run("pareto_share") == [{"top_share": 0.0, "bottom_share": 1.0}]


def test_relationship_check_counts_both_directions(ledger_of, accounts_of):
    ledger = ledger_of({"customer_id": 1}, {"customer_id": 1}, {"customer_id": 9}, {"customer_id": None})
    accounts = accounts_of(ACCOUNT, (2, "SME", "Active", "Web"), (3, "SME", "Active", "Web"))
    assert rows(profiling.relationship_check(ledger, accounts)) == [
        {
            "customer_records": 3,
            "transaction_records": 4,
            "orphan_transactions": 2,
            "customers_without_transactions": 2,
        }
    ]


def test_ztest_without_focus_rows_is_empty(ledger_of):
    assert rows(statistics.two_proportion_ztest(ledger_of({"channel": "POS"}, {"channel": "ATM"}))) == []


def test_ztest_against_hand_arithmetic(ledger_of):
    failures = [{"status": "Failed"}] * 20 + [{}] * 80 + [{"channel": "POS", "status": "Failed"}] * 10
    got = rows(statistics.two_proportion_ztest(ledger_of(*failures, *[{"channel": "POS"}] * 190)))[0]
    assert got["focus_failure_pct"] == 20.0 and got["other_failure_pct"] == 5.0
    assert (got["ci95_low_pp"], got["ci95_high_pp"]) == (6.6, 23.4)
    assert got["z_score"] == 4.08 and got["conclusion"] == "Significant at 5%"


def test_no_failures_give_no_z(ledger_of):
    got = rows(statistics.two_proportion_ztest(ledger_of({}, {"channel": "POS"})))[0]
    assert got["z_score"] is None and got["conclusion"] == "Not significant at 5%"


def test_ratio_is_null_where_a_side_is_empty(ledger_of):
    ledger = ledger_of({"risk_flag": "Yes"}, {}, {"txn_type": "Deposit", "international": "Yes"}, {"txn_type": "Deposit"})
    got = {r["txn_type"]: r for r in rows(rates.international_ratio(ledger))}
    assert got["Transfer"]["intl_review_rate_pct"] is None and got["Transfer"]["intl_to_domestic_ratio"] is None
    assert got["Transfer"]["domestic_review_rate_pct"] == 50.0
    assert got["Deposit"]["intl_to_domestic_ratio"] is None  # domestic rate 0


def test_missing_category_is_kept_in_sql_reports_and_dropped_in_frame_reports(ledger_of):
    ledger = ledger_of({"channel": None}, {"channel": None, "status": "Failed"}, {"channel": "Web"})
    assert {r["channel"] for r in rows(rates.channel_rates(ledger))} == {None, "Web"}
    assert {r["channel"] for r in rows(rates.failure_rate_by_channel(ledger))} == {"Web"}
    typed = ledger_of({"txn_type": None, "amount": 4.0}, {"txn_type": None, "amount": 6.0}, {"amount": 1.0})
    got = {r["txn_type"]: r["median_value"] for r in rows(rates.type_value_skew(typed))}
    assert got == {None: 5.0, "Transfer": 1.0}


def test_value_columns_without_a_match(ledger_of, accounts_of):
    ledger = ledger_of({"status": "Failed", "amount": 40.0})
    assert rows(rates.value_not_completed(ledger))[0]["avg_successful"] is None
    assert rows(rates.value_not_completed(ledger_of({})))[0]["not_completed_value"] is None
    model = rows(customers.customer_model(ledger, accounts_of(ACCOUNT)))[0]
    assert (model["value_success"], model["success_rate"]) == (0.0, 0.0)


def test_scorecard_rules_only_widen(ledger_of):
    ledger = ledger_of(
        {"amount": 100_000.0, "risk_flag": "Yes"},
        {"international": "Yes", "txn_type": "Deposit", "risk_flag": "Yes"},
        {"txn_type": "Transfer", "risk_flag": "Yes"},
        {"txn_type": "Cash Withdrawal"},
        {"txn_type": "Deposit"},
    )
    got = rows(rules.rule_scorecard(ledger))
    assert [r["txns_selected"] for r in got] == [1, 2, 4]
    assert [r["recall_pct"] for r in got] == [33.3, 66.7, 100.0]
    assert [r["precision_pct"] for r in got] == [100.0, 100.0, 75.0]
    assert got[0]["lift"] == 1.67


def test_gaps_inside_and_across_minutes(ledger_of):
    times = [(0, 0, 59, "Yes"), (0, 1, 1, "No"), (0, 1, 30, "Yes"), (1, 1, 0, "No"), (2, 2, 0, "Yes")]
    ledger = ledger_of(
        *[{"txn_ts": DAY.replace(hour=h, minute=m, second=s), "risk_flag": f} for h, m, s, f in times],
        {"txn_ts": DAY + dt.timedelta(days=30)},
        {"customer_id": None, "txn_ts": DAY},
        {"customer_id": None, "txn_ts": DAY},
    )
    got = {r["gap_since_previous"]: (r["txn_count"], r["review_rate_pct"]) for r in rows(sequence.gap_since_previous(ledger))}
    assert got == {
        "0: first transaction": (2, 50.0),
        "1: within 1 hour": (4, 25.0),
        "2: within 24 hours": (1, 100.0),
        "4: over 7 days": (1, 0.0),
    }


def test_equal_timestamps_go_by_transaction_id(ledger_of):
    same = [{"txn_id": i, "txn_ts": DAY, "risk_flag": "Yes" if i == 11 else "No"} for i in (13, 11, 12)]
    got = {r["gap_since_previous"]: r["review_rate_pct"] for r in rows(sequence.gap_since_previous(ledger_of(*same)))}
    assert got == {"0: first transaction": 100.0, "1: within 1 hour": 0.0}


def test_pending_age_counts_date_boundaries(ledger_of):
    late = DAY.replace(hour=23, minute=59)
    ledger = ledger_of(
        {"txn_ts": late, "status": "Pending"},
        {"txn_ts": DAY + dt.timedelta(days=1, hours=15), "status": "Pending", "amount": 7.0},
        {"txn_ts": DAY + dt.timedelta(days=2)},
    )
    got = {r["pending_age"]: r["pending_txns"] for r in rows(sequence.pending_age(ledger))}
    assert got == {"1: 0-1 days": 1, "2: 2-7 days": 1}


def test_amount_band_edges(ledger_of):
    amounts = [999.0, 1000.0, 9999.0, 10_000.0, 50_000.0, 100_000.0, 249_999.0, 250_000.0]
    got = [r["txn_count"] for r in rows(rates.review_rate_by_amount_band(ledger_of(*[{"amount": a} for a in amounts])))]
    assert got == [1, 2, 1, 1, 2, 1]


def test_lift_uses_thin_pairs_for_the_platform_rate(ledger_of):
    big = [{"status": "Failed"}] * 10 + [{}] * 90
    thin = [{"channel": "ATM", "status": "Failed"}] * 10
    got = rows(rates.failure_lift_combos(ledger_of(*big, *thin)))
    assert [(r["channel"], r["platform_rate_pct"], r["failure_lift"]) for r in got] == [("Mobile App", 18.18, 0.55)]


def test_crosstab_and_expected_fill_absent_pairs(ledger_of):
    ledger = ledger_of({"international": "Yes"}, {}, {"risk_flag": "Yes"})
    assert rows(rates.crosstab(ledger)) == [
        {"international": "No", "No": 1, "Yes": 1},
        {"international": "Yes", "No": 1, "Yes": 0},
    ]
    got = {(r["international"], r["risk_flag"]): (r["observed"], r["expected"]) for r in rows(statistics.expected_counts(ledger))}
    assert got[("Yes", "Yes")] == (0, 0.3333) and sum(o for o, _ in got.values()) == 3


def test_chi_square_shapes(ledger_of):
    # 2x2, 10/20/30/40: corrected statistic 0.4464...; worked by hand from |ad - bc|.
    cells = [("No", "No", 10), ("No", "Yes", 20), ("Yes", "No", 30), ("Yes", "Yes", 40)]
    ledger = ledger_of(*[{"international": a, "risk_flag": b} for a, b, n in cells for _ in range(n)])
    got = rows(statistics.chi_square_independence(ledger))[0]
    by_hand = 100 * (abs(10 * 40 - 20 * 30) - 50) ** 2 / (30 * 70 * 40 * 60)
    assert got["chi2"] == pytest.approx(by_hand, abs=1e-6) and got["dof"] == 1 and not got["significant"]
    # One value on a side: nothing to test.
    assert rows(statistics.chi_square_independence(ledger_of({}, {})))[0]["p_value"] == 1.0
    # 2x3 without correction: observed 10 and 0 twice against 5 each.
    wide = [{"international": "Yes", "channel": "Web"}] * 10 + [{"channel": "ATM"}] * 10
    got = rows(statistics.chi_square_independence(ledger_of(*wide, *[{"channel": "POS"}] * 10), "international", "channel"))[0]
    assert (got["chi2"], got["dof"], got["p_value"], got["significant"]) == (30.0, 2, 0.0, True)


def test_correlation_with_a_constant_column_is_null(ledger_of, accounts_of, spark):
    model = spark.createDataFrame([(1.0, 5.0, 2.0), (2.0, 5.0, 4.0), (3.0, 5.0, 7.0)], "a double, b double, c double")
    got = {(r["metric_x"], r["metric_y"]): r["correlation"] for r in rows(statistics.correlation_matrix(model, ["a", "b", "c"]))}
    assert got[("a", "b")] is None and got[("b", "b")] is None
    assert got[("a", "a")] == 1.0 and got[("a", "c")] == got[("c", "a")] == 0.993399


def test_quintile_edges_that_coincide(ledger_of, accounts_of):
    ledger = ledger_of(*[{"customer_id": c, "amount": float(c)} for c in range(1, 7)])
    accounts = accounts_of(*[(c, "SME", "Active", "Web") for c in range(1, 7)])
    model = customers.customer_model(ledger, accounts)
    with pytest.raises(Exception, match="quintile edges coincide"):
        rfm.rfm_quintiles(model).collect()
    kept = rfm.rfm_quintiles(model, on_duplicate="keep").orderBy("customer_id").collect()
    assert [r.m_score for r in kept] == [1, 1, 2, 3, 4, 5]
    assert {r.f_score for r in kept} == {1}
    with pytest.raises(ValueError):
        rfm.rfm_quintiles(model, on_duplicate="drop")


def test_merge_left_check_equals_the_join(ledger_of, accounts_of):
    ledger = ledger_of({"customer_id": 1, "channel": None}, {"customer_id": 2}, {"customer_id": 2}, {"customer_id": None})
    accounts = accounts_of((1, None, "Active", None), (2, "SME", None, "Web"), (2, None, None, None))
    joined = ledger.join(accounts, "customer_id", "left")
    nulls = sum(v is None for r in joined.collect() for v in r)
    assert rows(profiling.merge_left_check(ledger, accounts)) == [
        {"row_total": joined.count(), "column_total": len(joined.columns), "null_total": nulls}
    ]


def test_duplicates_beyond_the_first(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "a"), (2, None), (2, None)], "x int, y string")
    assert rows(profiling.profile_duplicates(df)) == [{"duplicate_rows": 3}]


def test_single_amount_histogram(ledger_of):
    got = rows(statistics.log_histogram(ledger_of({"amount": 10.0}, {"amount": 10.0}, {"amount": 0.0})))
    assert len(got) == 60 and (got[0]["log10_from"], got[-1]["log10_to"]) == (0.5, 1.5)
    assert got[30]["rows"] == 2 and sum(r["rows"] for r in got) == 2


def test_box_whiskers_leave_fliers_out(ledger_of):
    amounts = [1.0, 2.0, 3.0, 4.0, 100.0]
    ledger = ledger_of(*[{"amount": a} for a in amounts])
    got = rows(statistics.box_stats(ledger))[0]
    assert (got["q1"], got["median"], got["q3"]) == (2.0, 3.0, 4.0)
    assert (got["whisker_low"], got["whisker_high"]) == (1.0, 4.0)


def test_reconcile_reports_every_kind_of_difference(spark):
    left = spark.createDataFrame([("a", 1.0, None), ("b", 2.0, 5.0)], "k string, x double, y double")
    right = spark.createDataFrame([("a", 1.05, None), ("c", 2.0, 5.0)], "k string, x double, y double")
    got = {(r["k"], r["measure"]): r["matches"] for r in rows(kpi.reconcile(left, right, ["k"], tolerance=0.1))}
    assert got == {
        ("a", "x"): True,
        ("a", "y"): True,
        ("b", "x"): False,
        ("b", "y"): False,
        ("c", "x"): False,
        ("c", "y"): False,
    }
    with pytest.raises(ValueError):
        kpi.reconcile(left, right.drop("y"), ["k"])


def test_cumulative_curve_ends_at_everything(ledger_of):
    ledger = ledger_of(*[{"customer_id": c, "amount": float(10 * c)} for c in (1, 2, 3, 4)])
    curve = concentration.cumulative_value_curve(ledger).orderBy("customer_rank")
    assert [(r.customer_id, r.pct_customers, r.cumulative_value_pct) for r in curve.collect()] == [
        (4, 25.0, 40.0),
        (3, 50.0, 70.0),
        (2, 75.0, 90.0),
        (1, 100.0, 100.0),
    ]


def test_tiers_divide_repeated_rows(ledger_of):
    """Ten copies of each of ten transactions: tiers hold 1, 4, 15 and 80 of the hundred rows."""
    ledger = ledger_of(*[{"txn_id": i, "amount": float(i)} for i in range(1, 11)] * 10)
    got = rows(concentration.value_tiers(ledger))
    assert [(r["txn_count"], r["total_value"], r["min_amount"]) for r in got] == [
        (1, 10.0, 10.0),
        (4, 40.0, 10.0),
        (15, 140.0, 9.0),
        (80, 360.0, 1.0),
    ]


def test_missing_amounts_rank_last(ledger_of):
    ledger = ledger_of(*[{"customer_id": c, "amount": None if c == 1 else float(c)} for c in range(1, 11)])
    deciles = rows(concentration.value_deciles(ledger))
    assert deciles[0]["total_value"] == 10.0 and deciles[9]["total_value"] is None
    scores = {r["customer_id"]: r["m_score"] for r in rows(rfm.customer_rfm(ledger))}
    assert scores[1] == 4 and scores[2] == 1
    curve = {r["customer_id"]: r for r in rows(concentration.cumulative_value_curve(ledger))}
    assert curve[1]["customer_rank"] == 10 and curve[1]["cumulative_value_pct"] == 100.0
    top = rows(concentration.value_tiers(ledger_of(*[{"amount": None if i < 2 else float(i)} for i in range(100)])))[0]
    assert (top["txn_count"], top["total_value"]) == (1, 99.0)


def test_transactions_without_a_time_have_no_gap(ledger_of):
    day = dt.datetime(2026, 2, 1, 23, 50)
    times = [day, day + dt.timedelta(minutes=20), None, None, day + dt.timedelta(days=9), day + dt.timedelta(days=9)]
    ledger = ledger_of(*[{"txn_ts": t, "risk_flag": "Yes" if t is None else "No"} for t in times])
    got = {r["gap_since_previous"]: (r["txn_count"], r["review_rate_pct"]) for r in rows(sequence.gap_since_previous(ledger))}
    assert got == {
        "0: first transaction": (3, 66.67),
        "1: within 1 hour": (2, 0.0),
        "4: over 7 days": (1, 0.0),
    }


def test_many_categories_in_the_chi_square_test(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    cells = [(f"r{i}", f"c{j}") for i, j in rng.integers(0, 3_000, size=(20_000, 2))]
    df = spark.createDataFrame(cells, "international string, risk_flag string").repartition(4)
    got = rows(statistics.chi_square_independence(df))[0]
    observed, row_total, column_total = {}, {}, {}
    for r, c in cells:
        observed[r, c] = observed.get((r, c), 0) + 1
        row_total[r] = row_total.get(r, 0) + 1
        column_total[c] = column_total.get(c, 0) + 1
    fit = sum(n * n / (row_total[r] * column_total[c]) for (r, c), n in observed.items())
    assert got["dof"] == (len(row_total) - 1) * (len(column_total) - 1)
    assert got["chi2"] == pytest.approx(len(cells) * (fit - 1), rel=1e-9)
