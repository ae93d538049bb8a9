"""How value is spread over customers and transactions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens import fixed_values as fv
from ledgerlens.functions.exprs import band, flagged, pct, ratio, round_to, row_count, successful
from ledgerlens.operators.rates import share_of_all
from ledgerlens.plans.bins import counted_tiles
from ledgerlens.plans.ordering import (
    fraction_ranks,
    ntile_ranks,
    quantile_ranks,
    running_totals,
    unique_rows,
    with_tiles,
)


def customer_value(ledger: DataFrame, condition: Column | None = None) -> DataFrame:
    rows = ledger if condition is None else ledger.filter(condition)
    return rows.groupBy("customer_id").agg(F.sum("amount").alias("value"))


def _highest_first(value: str = "value") -> Column:
    return -F.col(value)


def value_deciles(ledger: DataFrame, tiles: int = 10) -> DataFrame:
    """Successful value by customer tenth, highest first; sizes differ by one at most."""
    per_customer = customer_value(ledger, successful())
    ranked = with_tiles(per_customer, {"decile": _highest_first()}, "customer_id", ntile_ranks(tiles))
    per_decile = ranked.groupBy("decile").agg(row_count().alias("customers"), F.sum("value").alias("value"))
    return per_decile.select(
        "decile",
        "customers",
        round_to(F.col("value"), 0).alias("total_value"),
        share_of_all(F.col("value")).alias("pct_of_total_value"),
    ).orderBy("decile")


def _framed_value(ledger: DataFrame) -> DataFrame:
    """Value per customer as data frames sum it: rows without a customer drop out, missing amounts add nothing."""
    per_customer = customer_value(ledger.filter(F.col("customer_id").isNotNull()))
    return per_customer.withColumn("value", F.coalesce("value", F.lit(0)))


def _quantile_deciles(ledger: DataFrame, tiles: int) -> DataFrame:
    return with_tiles(_framed_value(ledger), {"decile": _highest_first()}, "customer_id", quantile_ranks(tiles))


def value_decile_share_all(ledger: DataFrame, tiles: int = 10) -> DataFrame:
    """Share of value over all statuses by customer tenth, cut at quantile edges of the rank.

    The cumulative column holds the top-10 % and top-30 % figures; the bottom half is what
    the fifth row leaves to 100.
    """
    ranked = _quantile_deciles(ledger, tiles)
    per_decile = ranked.groupBy("decile").agg(row_count().alias("customers"), F.sum("value").alias("value"))
    return per_decile.select(
        "decile", "customers", share_of_all(F.col("value")).alias("share_pct")
    ).orderBy("decile")


def concentration_summary(ledger: DataFrame) -> DataFrame:
    """Share of all-status value held by the top 10 %, the top 30 % and the bottom 50 % of customers."""
    ranked = _quantile_deciles(ledger, 10)

    def share(condition: Column, name: str) -> Column:
        return pct(F.sum(F.when(condition, F.col("value")).otherwise(0)), F.sum("value"), 1).alias(name)

    decile = F.col("decile")
    return ranked.agg(
        share(decile == 1, "top10_pct"), share(decile <= 3, "top30_pct"), share(decile > 5, "bottom50_pct")
    )


def cumulative_value_curve(ledger: DataFrame) -> DataFrame:
    """One point per customer, highest value first: % of customers against cumulative % of value."""
    per_customer = _framed_value(ledger).select(
        "customer_id", "value", _highest_first().alias("order_value"), F.lit(1).cast("bigint").alias("customers")
    )
    ranked = running_totals(per_customer, ["order_value", "customer_id"], ["customers", "value"])
    return ranked.select(
        F.col("customers_to").alias("customer_rank"),
        "customer_id",
        pct(F.col("customers_to"), F.col("customers_all"), 6).alias("pct_customers"),
        pct(F.col("value_to"), F.col("value_all"), 6).alias("cumulative_value_pct"),
    )


def value_tiers(ledger: DataFrame) -> DataFrame:
    """Successful transactions by size tier in hundredths of their count, with review rate."""

    def tier_ranks(n: Column) -> list[Column]:
        hundredths = ntile_ranks(100)(n)
        return [hundredths[cut - 1] for cut in fv.TIER_HUNDREDTHS]

    paid = ledger.filter(successful()).select("txn_id", "amount", "risk_flag")
    flag = F.coalesce(flagged(), F.lit(False)).cast("bigint")
    ranked = counted_tiles(paid, "amount", "txn_id", {"flags": flag}, tier_ranks)
    tier = band(F.col("tile"), (1, 2, 3), fv.TIER_LABELS, inclusive=True)
    per_tier = ranked.groupBy(tier.alias("tier")).agg(
        F.sum("rows").alias("txn_count"),
        F.sum("total").alias("value"),
        F.min("least").alias("least"),
        F.sum("flags").alias("flags"),
    )
    return per_tier.select(
        "tier",
        "txn_count",
        round_to(F.col("value"), 0).alias("total_value"),
        share_of_all(F.col("value"), 1).alias("pct_of_value"),
        round_to(F.col("least"), 0).alias("min_amount"),
        pct(F.col("flags"), F.col("txn_count"), 1).alias("review_rate_pct"),
    ).orderBy("tier")


def pareto_share(model: DataFrame, top: float = 0.10, half: float = 0.50) -> DataFrame:
    """Share of successful value from the top tenth and from the lower half of customers."""
    model, copy = unique_rows(model.select("customer_id", "value_success"), "customer_id")
    ranked = with_tiles(model, {"part": _highest_first("value_success")}, copy, fraction_ranks(top, half))
    value = F.col("value_success")

    def share(condition: Column) -> Column:
        return ratio(F.sum(F.when(condition, value).otherwise(0)), F.sum(value))

    return ranked.agg(
        round_to(share(F.col("part") == 1), 6).alias("top_share"),
        round_to(share(F.col("part") == 3), 6).alias("bottom_share"),
    )
