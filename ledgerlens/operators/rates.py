"""Grouped counts, rates, shares and pivots over the transaction ledger.

All of them are one scan with a map-side aggregation to a row per category; what follows
(shares, ratios, ordering) touches only those rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens import fixed_values as fv
from ledgerlens.functions.exprs import (
    band,
    failed,
    flagged,
    is_international,
    month_label,
    pct,
    ratio,
    round_to,
    row_count,
    successful,
)
from ledgerlens.plans.bins import items, percentile


def total_over_categories(column: str | Column) -> Column:
    """Total of an already aggregated frame, one row per category, on each of its rows."""
    return F.sum(column).over(Window.partitionBy())


def share_of_all(part: Column, digits: int = 2) -> Column:
    """Percentage of the column total over an already aggregated frame."""
    return pct(part, total_over_categories(part), digits)


def rates_by(
    ledger: DataFrame,
    by: str | Column,
    rates: Mapping[str, Column],
    extra: Sequence[Column] = (),
    digits: int = 2,
) -> DataFrame:
    """Rows per category and the percentage of them meeting each condition."""
    return ledger.groupBy(by).agg(
        row_count().alias("txn_count"),
        *extra,
        *[pct(F.count_if(condition), row_count(), digits).alias(name) for name, condition in rates.items()],
    )


def status_share(ledger: DataFrame, key: str = "status") -> DataFrame:
    """Count, share of rows and value of each status."""
    per_key = ledger.groupBy(key).agg(row_count().alias("txn_count"), F.sum("amount").alias("value"))
    return per_key.select(
        key,
        "txn_count",
        share_of_all(F.col("txn_count")).alias("pct_of_txns"),
        round_to(F.col("value"), 0).alias("total_value"),
    ).orderBy(F.desc("txn_count"), key)


def type_value_skew(ledger: DataFrame, by: str = "txn_type") -> DataFrame:
    """Successful value per type with mean against exact median."""
    sums = {"n": row_count(), "total": F.sum("amount"), "counted": F.count("amount")}
    paid = items(ledger.filter(successful()), "amount", [0.5], [by], sums)
    per_type = paid.groupBy(by).agg(
        *[F.sum(c).alias(c) for c in sums],
        percentile(0.5).alias("median"),
    )
    return per_type.select(
        by,
        F.col("n").alias("txn_count"),
        round_to(F.col("total"), 0).alias("total_value"),
        round_to(ratio(F.col("total"), F.col("counted")), 0).alias("avg_value"),
        round_to(F.col("median"), 0).alias("median_value"),
    ).orderBy(F.desc("total_value"), by)


def channel_rates(ledger: DataFrame, by: str = "channel") -> DataFrame:
    rates = {"success_rate_pct": successful(), "failure_rate_pct": failed()}
    return rates_by(ledger, by, rates).orderBy(F.desc("txn_count"), by)


def review_rate_by_type(ledger: DataFrame, by: str = "txn_type") -> DataFrame:
    return rates_by(ledger, by, {"review_rate_pct": flagged()}).orderBy(F.desc("review_rate_pct"), by)


def international_profile(ledger: DataFrame) -> DataFrame:
    """Average over all statuses, review and success rate, domestic against international."""
    average = round_to(F.avg("amount"), 0).alias("avg_value")
    rates = {"review_rate_pct": flagged(), "success_rate_pct": successful()}
    return rates_by(ledger, "international", rates, [average]).orderBy("international")


def review_rate_by_amount_band(
    ledger: DataFrame, cuts: Sequence[float] = fv.AMOUNT_CUTS, labels: Sequence[str] = fv.AMOUNT_LABELS
) -> DataFrame:
    by = band(F.col("amount"), cuts, labels).alias("amount_band")
    return rates_by(ledger, by, {"review_rate_pct": flagged()}).orderBy("amount_band")


def monthly_activity(ledger: DataFrame) -> DataFrame:
    """Volume per month and per active day.

    Counting per day first makes the active days a plain row count per month.
    """
    daily = ledger.groupBy(F.to_date("txn_ts").alias("day")).agg(
        row_count().alias("rows"),
        F.count_if(successful() & F.col("amount").isNotNull()).alias("paid"),
        F.sum(F.when(successful(), F.col("amount"))).alias("paid_value"),
    )
    rows, days = F.sum("rows"), F.count("day")
    return (
        daily.groupBy(month_label(F.col("day")).alias("month"))
        .agg(
            rows.alias("txn_count"),
            days.alias("active_days"),
            round_to(ratio(rows, days), 0).alias("txns_per_day"),
            round_to(ratio(F.sum("paid_value"), F.sum("paid")), 0).alias("avg_successful"),
        )
        .orderBy(F.asc_nulls_last("month"))
    )


def time_of_day_rates(ledger: DataFrame) -> DataFrame:
    by = band(F.hour("txn_ts"), fv.HOUR_CUTS, fv.HOUR_LABELS).alias("time_band")
    average = round_to(F.avg("amount"), 0).alias("avg_value")
    rates = {"failure_rate_pct": failed(), "review_rate_pct": flagged()}
    return rates_by(ledger, by, rates, [average]).orderBy("time_band")


def failure_lift_combos(
    ledger: DataFrame, min_rows: int = fv.MIN_COMBO_ROWS, top: int = fv.TOP_COMBOS
) -> DataFrame:
    """Channel and type pairs failing most against the platform rate, thin pairs left out.

    The platform rate counts every pair, the thin ones included.
    """
    combos = ledger.groupBy("channel", "txn_type").agg(
        row_count().alias("txn_count"), F.count_if(failed()).alias("failed_txns")
    )
    rate = ratio(F.col("failed_txns"), F.col("txn_count"))
    platform = ratio(total_over_categories("failed_txns"), total_over_categories("txn_count"))
    return (
        combos.withColumn("platform", platform)
        .filter(F.col("txn_count") >= min_rows)
        .select(
            "channel",
            "txn_type",
            "txn_count",
            "failed_txns",
            pct(F.col("failed_txns"), F.col("txn_count")).alias("failure_rate_pct"),
            round_to(100 * F.col("platform"), 2).alias("platform_rate_pct"),
            round_to(ratio(rate, F.col("platform")), 2).alias("failure_lift"),
        )
        .orderBy(F.desc("failure_lift"), "channel", "txn_type")
        .limit(top)
    )


def value_not_completed(ledger: DataFrame, by: str = "txn_type") -> DataFrame:
    """Attempted value that did not complete, and whether failures are the larger amounts."""
    amount = F.col("amount")
    lost = F.sum(F.when(~successful(), amount))
    return (
        ledger.groupBy(by)
        .agg(
            round_to(F.sum(amount), 0).alias("attempted_value"),
            round_to(lost, 0).alias("not_completed_value"),
            pct(lost, F.sum(amount)).alias("pct_value_not_completed"),
            round_to(F.avg(F.when(failed(), amount)), 0).alias("avg_failed"),
            round_to(F.avg(F.when(successful(), amount)), 0).alias("avg_successful"),
        )
        .orderBy(F.desc_nulls_last("not_completed_value"), by)
    )


def international_ratio(ledger: DataFrame, by: str = "txn_type") -> DataFrame:
    """International against domestic review rate inside each type; NULL where a side is empty."""
    home = F.col("international") == fv.NO
    abroad = is_international()
    return (
        ledger.groupBy(by)
        .agg(
            F.count_if(abroad).alias("intl_txns"),
            F.count_if(home).alias("home_txns"),
            F.count_if(abroad & flagged()).alias("intl_flagged"),
            F.count_if(home & flagged()).alias("home_flagged"),
        )
        .select(
            by,
            "intl_txns",
            pct(F.col("intl_flagged"), F.col("intl_txns")).alias("intl_review_rate_pct"),
            pct(F.col("home_flagged"), F.col("home_txns")).alias("domestic_review_rate_pct"),
            round_to(
                ratio(
                    ratio(F.col("intl_flagged"), F.col("intl_txns")),
                    ratio(F.col("home_flagged"), F.col("home_txns")),
                ),
                2,
            ).alias("intl_to_domestic_ratio"),
        )
        .orderBy(by)
    )


def value_counts_share(df: DataFrame, key: str) -> DataFrame:
    """Rows and share per category, missing categories left out."""
    return (
        df.filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(row_count().alias("rows"))
        .select(key, "rows", share_of_all(F.col("rows")).alias("share_pct"))
        .orderBy(F.desc("rows"), key)
    )


def value_by_type_millions(ledger: DataFrame, by: str = "txn_type") -> DataFrame:
    """Successful value in millions, smallest first."""
    return (
        ledger.filter(successful() & F.col(by).isNotNull())
        .groupBy(by)
        .agg(F.sum("amount").alias("value"))
        .select(by, round_to(ratio(F.col("value"), F.lit(fv.MILLION)), 6).alias("value_millions"))
        .orderBy("value_millions", by)
    )


def _single_rate(ledger: DataFrame, by: str, condition: Column, name: str, digits: int) -> DataFrame:
    kept = ledger.filter(F.col(by).isNotNull())
    return kept.groupBy(by).agg(pct(F.count_if(condition), row_count(), digits).alias(name)).orderBy(name, by)


def failure_rate_by_channel(ledger: DataFrame) -> DataFrame:
    return _single_rate(ledger, "channel", failed(), "failure_rate_pct", 2)


def review_rate_by_type_1dp(ledger: DataFrame) -> DataFrame:
    return _single_rate(ledger, "txn_type", flagged(), "review_rate_pct", 1)


def crosstab(ledger: DataFrame, row: str = "international", column: str = "risk_flag", values=(fv.NO, fv.YES)) -> DataFrame:
    """Row counts of two categories against each other, 0 where a pair never occurs."""
    return (
        ledger.filter(F.col(row).isNotNull())
        .groupBy(row)
        .pivot(column, list(values))
        .agg(row_count())
        .na.fill(0, list(values))
        .orderBy(row)
    )


def risk_pivot(ledger: DataFrame, channels: Sequence[str] = fv.CHANNELS) -> DataFrame:
    """Review rate (0..1) by type and channel, one column per channel; NULL where a pair never occurs."""
    per_pair = ratio(F.count_if(flagged()), row_count())
    return (
        ledger.filter(F.col("txn_type").isNotNull())
        .groupBy("txn_type")
        .pivot("channel", list(channels))
        .agg(round_to(per_pair, 6))
        .orderBy("txn_type")
    )


def risk_matrix_by_counts(ledger: DataFrame, channels: Sequence[str] = fv.CHANNELS) -> DataFrame:
    """The figures of `risk_pivot` by another path: one conditional average per channel."""
    is_flag = flagged().cast("double")
    return (
        ledger.filter(F.col("txn_type").isNotNull())
        .groupBy("txn_type")
        .agg(*[round_to(F.avg(F.when(F.col("channel") == c, is_flag)), 6).alias(c) for c in channels])
    )


def monthly_trend(ledger: DataFrame) -> DataFrame:
    """Value over all statuses per month and its growth on the month before."""
    monthly = (
        ledger.filter(F.col("txn_ts").isNotNull())
        .groupBy(month_label(F.col("txn_ts")).alias("month"))
        .agg(
            F.sum("amount").alias("total_value"),
            row_count().alias("txn_count"),
            F.count_if(flagged()).alias("flag_count"),
        )
    )
    # One row per calendar month.
    previous = F.lag("total_value").over(Window.partitionBy().orderBy("month"))
    growth = ratio(F.col("total_value") - previous, previous)
    return monthly.select(
        "month",
        round_to(F.col("total_value"), 2).alias("total_value"),
        "txn_count",
        "flag_count",
        round_to(growth, 6).alias("mom_growth"),
    ).orderBy("month")
