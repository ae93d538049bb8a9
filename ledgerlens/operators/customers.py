"""Operators that bring the customer table in.

Transactions are always reduced to a row per customer (and category) before the join. A
customer holding a third of the ledger then adds one row per map task, the join moves
customer-sized data, and distinct customers are counted on the partitioning the join
already has. No side is broadcast by hint; Spark does so when its size estimate allows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens import fixed_values as fv
from ledgerlens.functions.exprs import flagged, month_label, pct, ratio, round_to, row_count, successful
from ledgerlens.operators.rates import share_of_all


def _by_label(per_customer: DataFrame, accounts: DataFrame, label: str) -> DataFrame:
    return per_customer.join(accounts.select("customer_id", label), "customer_id")


def _customers() -> Column:
    return F.count_distinct("customer_id")


def segment_behaviour(ledger: DataFrame, accounts: DataFrame, label: str = "segment") -> DataFrame:
    """Successful transactions and value per customer of each segment."""
    per_customer = (
        ledger.filter(successful())
        .groupBy("customer_id")
        .agg(row_count().alias("rows"), F.sum("amount").alias("value"))
    )
    rows, customers = F.sum("rows"), _customers()
    return (
        _by_label(per_customer, accounts, label)
        .groupBy(label)
        .agg(
            customers.alias("customers"),
            rows.alias("txn_count"),
            round_to(ratio(rows, customers), 1).alias("txns_per_customer"),
            round_to(ratio(F.sum("value"), customers), 0).alias("value_per_customer"),
        )
        .orderBy(F.desc("value_per_customer"), label)
    )


def account_status_activity(ledger: DataFrame, accounts: DataFrame, label: str = "account_status") -> DataFrame:
    """Transactions of any status per customer of each account status."""
    per_customer = ledger.groupBy("customer_id").agg(row_count().alias("rows"))
    rows, customers = F.sum("rows"), _customers()
    return (
        _by_label(per_customer, accounts, label)
        .groupBy(label)
        .agg(
            customers.alias("customers"),
            rows.alias("txn_count"),
            round_to(ratio(rows, customers), 1).alias("txns_per_customer"),
        )
        .orderBy(F.desc("txn_count"), label)
    )


def preferred_channel_match(ledger: DataFrame, accounts: DataFrame, label: str = "preferred_channel") -> DataFrame:
    """Share of transactions made on the channel the customer says they prefer."""
    per_channel = ledger.groupBy("customer_id", "channel").agg(row_count().alias("rows"))
    matching = F.sum(F.when(F.col("channel") == F.col(label), F.col("rows")).otherwise(0))
    return (
        _by_label(per_channel, accounts, label)
        .groupBy(label)
        .agg(
            F.sum("rows").alias("txn_count"),
            pct(matching, F.sum("rows")).alias("pct_txns_on_preferred_channel"),
        )
        .orderBy(F.desc("txn_count"), label)
    )


def account_status_exposure(ledger: DataFrame, accounts: DataFrame, label: str = "account_status") -> DataFrame:
    """Successful value and review rate passing through each account status."""
    per_customer = ledger.groupBy("customer_id").agg(
        row_count().alias("rows"),
        F.count_if(successful()).alias("paid"),
        F.sum(F.when(successful(), F.col("amount"))).alias("paid_value"),
        F.count_if(flagged()).alias("flags"),
    )
    per_label = (
        _by_label(per_customer, accounts, label)
        .groupBy(label)
        .agg(
            _customers().alias("customers"),
            F.sum("paid").alias("successful_txns"),
            F.sum("paid_value").alias("paid_value"),
            pct(F.sum("flags"), F.sum("rows")).alias("review_rate_pct"),
        )
    )
    return per_label.select(
        label,
        "customers",
        "successful_txns",
        round_to(F.col("paid_value"), 0).alias("successful_value"),
        share_of_all(F.col("paid_value")).alias("pct_of_value"),
        "review_rate_pct",
    ).orderBy(F.desc_nulls_last("successful_value"), label)


def customer_model(ledger: DataFrame, accounts: DataFrame) -> DataFrame:
    """A row per customer with transactions of any status, rebuilt from the ledger."""
    paid = F.coalesce(F.sum(F.when(successful(), F.col("amount"))), F.lit(0))
    per_customer = (
        ledger.filter(F.col("customer_id").isNotNull())
        .groupBy("customer_id")
        .agg(
            F.count("txn_id").alias("txn_count"),
            F.count_if(successful()).alias("success_count"),
            paid.alias("value_success"),
            F.count_if(flagged()).alias("flag_count"),
            F.max("txn_ts").alias("last_txn"),
        )
        .withColumn("success_rate", ratio(F.col("success_count"), F.col("txn_count")))
    )
    return _by_label(per_customer, accounts, "segment")


def failure_distribution(ledger: DataFrame) -> DataFrame:
    """How many customers had 0, 1, 2, ... failures."""
    per_customer = ledger.groupBy("customer_id").agg(F.count_if(F.col("status") == fv.FAILED).alias("failed_txns"))
    return (
        per_customer.groupBy("failed_txns")
        .agg(row_count().alias("customers"))
        .select(
            "failed_txns",
            "customers",
            share_of_all(F.col("customers")).alias("pct_customers"),
            (F.col("failed_txns") * F.col("customers")).alias("failed_txns_total"),
        )
        .orderBy("failed_txns")
    )


def monthly_state(ledger: DataFrame) -> DataFrame:
    """What a month adds to each customer: rows, successful rows and value, flags, and newest times.

    All of it merges, so stored months need not be read again: a new month is one pass over its own rows, and
    `merge_states` takes any union of months, or of states that were merged before.
    """
    paid = successful()
    return ledger.groupBy("customer_id", month_label(F.col("txn_ts")).alias("month")).agg(
        F.count("txn_id").alias("txn_count"),
        F.count_if(paid).alias("success_count"),
        F.count_if(flagged()).alias("flag_count"),
        F.sum(F.when(paid, F.col("amount"))).alias("value_success"),
        F.max("txn_ts").alias("any_ts"),
        F.max(F.when(paid, F.col("txn_ts"))).alias("last_paid_ts"),
    )


def merge_states(states: DataFrame) -> DataFrame:
    """One state per customer; merging merged states gives the same."""
    return states.groupBy("customer_id").agg(
        *[F.sum(c).alias(c) for c in ("txn_count", "success_count", "flag_count", "value_success")],
        *[F.max(c).alias(c) for c in ("any_ts", "last_paid_ts")],
    )


def customer_model_of(state: DataFrame, accounts: DataFrame) -> DataFrame:
    """`customer_model` from merged states instead of the ledger."""
    per_customer = state.filter(F.col("customer_id").isNotNull()).select(
        "customer_id",
        "txn_count",
        "success_count",
        F.coalesce("value_success", F.lit(0)).alias("value_success"),
        "flag_count",
        F.col("any_ts").alias("last_txn"),
        ratio(F.col("success_count"), F.col("txn_count")).alias("success_rate"),
    )
    return _by_label(per_customer, accounts, "segment")
