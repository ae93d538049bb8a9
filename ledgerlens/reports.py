"""Every report by name, as a function of the two tables with the agreed default settings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ledgerlens.operators import concentration, customers, kpi, profiling, rates, rfm, rules, sequence, statistics
from ledgerlens.sources import ledger as tables

Report = Callable[..., DataFrame]


def _of_both(operator: Callable[..., DataFrame]) -> Report:
    return lambda ledger, accounts: operator(ledger, accounts)


def _of_ledger(operator: Callable[..., DataFrame]) -> Report:
    return lambda ledger, accounts: operator(ledger)


def _of_accounts(operator: Callable[..., DataFrame]) -> Report:
    return lambda ledger, accounts: operator(accounts)


def _of_model(operator: Callable[..., DataFrame]) -> Report:
    return lambda ledger, accounts: operator(customers.customer_model(ledger, accounts))


REPORTS: dict[str, Report] = {
    # relationship and status
    "relationship_check": _of_both(profiling.relationship_check),
    "status_share": _of_ledger(rates.status_share),
    # rates by one dimension
    "type_value_skew": _of_ledger(rates.type_value_skew),
    "channel_rates": _of_ledger(rates.channel_rates),
    "review_rate_by_type": _of_ledger(rates.review_rate_by_type),
    "international_profile": _of_ledger(rates.international_profile),
    "review_rate_by_amount_band": _of_ledger(rates.review_rate_by_amount_band),
    "monthly_activity": _of_ledger(rates.monthly_activity),
    "time_of_day_rates": _of_ledger(rates.time_of_day_rates),
    "value_not_completed": _of_ledger(rates.value_not_completed),
    "failure_lift_combos": _of_ledger(rates.failure_lift_combos),
    "stratified_ratio": _of_ledger(rates.international_ratio),
    # customers
    "segment_behaviour": _of_both(customers.segment_behaviour),
    "account_status_activity": _of_both(customers.account_status_activity),
    "preferred_channel_match": _of_both(customers.preferred_channel_match),
    "account_status_exposure": _of_both(customers.account_status_exposure),
    "failure_distribution": _of_ledger(customers.failure_distribution),
    "customer_model": _of_both(customers.customer_model),
    # concentration
    "value_deciles": _of_ledger(concentration.value_deciles),
    "value_tiers": _of_ledger(concentration.value_tiers),
    "value_decile_share_all": _of_ledger(concentration.value_decile_share_all),
    "concentration_summary": _of_ledger(concentration.concentration_summary),
    "cumulative_value_curve": _of_ledger(concentration.cumulative_value_curve),
    "pareto_share": _of_model(concentration.pareto_share),
    # recency, frequency, monetary
    "customer_rfm": _of_ledger(rfm.customer_rfm),
    "rfm_segment_summary": _of_ledger(lambda ledger: rfm.rfm_segment_summary(rfm.customer_rfm(ledger))),
    "rfm_vs_labels": lambda ledger, accounts: rfm.rfm_vs_labels(
        rfm.customer_rfm(ledger), accounts
    ),
    "rfm_quintiles": _of_model(rfm.rfm_quintiles),
    "rfm_quintile_summary": _of_model(lambda model: rfm.rfm_quintile_summary(rfm.rfm_quintiles(model))),
    # tests, rules, sequence
    "two_proportion_ztest": _of_ledger(statistics.two_proportion_ztest),
    "failure_concentration_test": _of_ledger(statistics.failure_concentration_test),
    "rule_scorecard": _of_ledger(rules.rule_scorecard),
    "pending_age": _of_ledger(sequence.pending_age),
    "gap_since_previous": _of_ledger(sequence.gap_since_previous),
    "kpi_summary": _of_ledger(kpi.kpi_summary),
    # loading and profiling
    "preview_transactions": _of_ledger(lambda ledger: tables.preview(ledger, "txn_id")),
    "preview_customers": _of_accounts(lambda accounts: tables.preview(accounts, "customer_id")),
    "derived_columns": _of_ledger(tables.derived_columns),
    "clean_ledger": _of_accounts(tables.clean),
    "profile_shape_transactions": _of_ledger(profiling.profile_shape),
    "profile_shape_customers": _of_accounts(profiling.profile_shape),
    "profile_nulls_transactions": _of_ledger(profiling.profile_nulls),
    "profile_nulls_customers": _of_accounts(profiling.profile_nulls),
    "profile_duplicates_transactions": _of_ledger(profiling.profile_duplicates),
    "profile_duplicates_customers": _of_accounts(profiling.profile_duplicates),
    "profile_describe_transactions": _of_ledger(profiling.profile_describe),
    "profile_describe_customers": _of_accounts(profiling.profile_describe),
    "merge_left_check": _of_both(profiling.merge_left_check),
    # tables behind the charts
    "status_value_counts": _of_ledger(lambda ledger: rates.value_counts_share(ledger, "status")),
    "preferred_channel_value_counts": _of_accounts(
        lambda accounts: rates.value_counts_share(accounts, "preferred_channel")
    ),
    "value_by_type_millions": _of_ledger(rates.value_by_type_millions),
    "log_histogram": _of_ledger(statistics.log_histogram),
    "box_stats": _of_ledger(statistics.box_stats),
    "amount_outliers": _of_ledger(statistics.amount_outliers),
    "failure_rate_by_channel": _of_ledger(rates.failure_rate_by_channel),
    "review_rate_by_type_1dp": _of_ledger(rates.review_rate_by_type_1dp),
    "crosstab": _of_ledger(rates.crosstab),
    "chi_square_independence": _of_ledger(statistics.chi_square_independence),
    "expected_counts": _of_ledger(statistics.expected_counts),
    "correlation_matrix": _of_both(
        lambda ledger, accounts: statistics.correlation_matrix(customers.customer_model(ledger, accounts))
    ),
    "risk_pivot": _of_ledger(rates.risk_pivot),
    "customer_value_outliers": _of_model(statistics.customer_value_outliers),
    "monthly_trend": _of_ledger(rates.monthly_trend),
}


# Reports that depend on exact ranks, percentiles or running totals.
RANKED = (
    "type_value_skew",
    "value_deciles",
    "value_tiers",
    "value_decile_share_all",
    "concentration_summary",
    "cumulative_value_curve",
    "pareto_share",
    "customer_rfm",
    "rfm_segment_summary",
    "rfm_vs_labels",
    "rfm_quintiles",
    "rfm_quintile_summary",
    "kpi_summary",
    "profile_describe_transactions",
    "profile_describe_customers",
    "box_stats",
    "amount_outliers",
    "customer_value_outliers",
)


def run(name: str, ledger: DataFrame, accounts: DataFrame) -> DataFrame:
    return REPORTS[name](ledger, accounts)
