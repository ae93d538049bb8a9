"""Questions about timing: gaps between a customer's transactions, age of pending ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens import fixed_values as fv
from ledgerlens.functions.exprs import band, flagged, minute_index, pct, round_to, row_count
from ledgerlens.operators.rates import share_of_all


def _gap_band(minutes: Column) -> Column:
    return F.when(minutes.isNull(), fv.FIRST_LABEL).otherwise(
        band(minutes, fv.GAP_CUTS, fv.GAP_LABELS, inclusive=True)
    )


def customer_minutes(ledger: DataFrame) -> DataFrame:
    """One row per customer and minute: customer_id, day, minute, rows `n`, flagged rows `f` and `first_flag`, the flag
    of the row that comes first by time and id. Rows without a time are one row of their own, with neither day nor minute.

    Rows of a minute are combined before the shuffle, so a customer, day or minute that holds a third of
    all rows sends a row per task, and no customer's day has more than 1,440 rows.
    """
    flag = F.coalesce(flagged(), F.lit(False)).cast("bigint")
    rows = ledger.select(
        "customer_id",
        F.to_date("txn_ts").alias("day"),
        minute_index(F.col("txn_ts")).alias("minute"),
        F.struct("txn_ts", "txn_id", flag.alias("flag")).alias("row"),
    )
    minutes = rows.groupBy("customer_id", "day", "minute").agg(
        row_count().alias("n"), F.sum("row.flag").alias("f"), F.min("row").alias("first")
    )
    return minutes.select("customer_id", "day", "minute", "n", "f", F.col("first.flag").alias("first_flag"))


def gap_since_previous(ledger: DataFrame) -> DataFrame:
    """Review rate by minutes since the same customer's previous transaction; one scan of the ledger.

    Gaps count minute boundaries, so all rows of a customer's minute but the first have a gap of 0, and only
    the first looks back: to the minute before in its day, or for the day's first minute to the last one of
    the customer's day before. A transaction without a time sorts last and has no gap, like a first one.
    """
    in_day = Window.partitionBy("customer_id", "day").orderBy("minute")
    minutes = customer_minutes(ledger).withColumn("gap", F.col("minute") - F.lag("minute").over(in_day))
    near = [(F.col("gap").isNotNull() & (_gap_band(F.col("gap")) == label)) for label in fv.GAP_LABELS]
    timed, first = F.col("minute").isNotNull(), F.col("gap").isNull()
    days = minutes.groupBy("customer_id", "day").agg(
        F.max("minute").alias("last"),
        F.min("minute").alias("minute"),
        F.max(F.when(timed & first, F.col("first_flag"))).alias("first_flag"),
        F.sum(F.when(timed, F.col("n") - 1)).alias("n_zero"),
        F.sum(F.when(timed, F.col("f") - F.col("first_flag"))).alias("f_zero"),
        F.sum(F.when(~timed, F.col("n"))).alias("n_none"),
        F.sum(F.when(~timed, F.col("f"))).alias("f_none"),
        *[F.count_if(c).alias(f"n{i}") for i, c in enumerate(near)],
        *[F.sum(F.when(c, F.col("first_flag"))).alias(f"f{i}") for i, c in enumerate(near)],
    )
    # A row without a day comes first and has no last minute, so the day after it is the first.
    earlier = F.lag("last").over(Window.partitionBy("customer_id").orderBy("day"))
    days = days.withColumn("gap", F.col("minute") - earlier)
    parts = [
        (_gap_band(F.col("gap")), F.when(F.col("day").isNotNull(), 1), F.col("first_flag")),
        (_gap_band(F.lit(0)), F.col("n_zero"), F.col("f_zero")),
        (F.lit(fv.FIRST_LABEL), F.col("n_none"), F.col("f_none")),
        *[(F.lit(label), F.col(f"n{i}"), F.col(f"f{i}")) for i, label in enumerate(fv.GAP_LABELS)],
    ]
    counted = days.select(
        F.inline(
            F.array(
                *[
                    F.struct(label.alias("gap_since_previous"), n.cast("bigint").alias("n"), f.cast("bigint").alias("f"))
                    for label, n, f in parts
                ]
            )
        )
    )
    return (
        counted.filter(F.col("n") > 0)
        .groupBy("gap_since_previous")
        .agg(F.sum("n").alias("txn_count"), pct(F.sum("f"), F.sum("n")).alias("review_rate_pct"))
        .orderBy("gap_since_previous")
    )


def pending_age(ledger: DataFrame) -> DataFrame:
    """Pending transactions and their value by age against the newest timestamp in the ledger."""
    newest = ledger.agg(F.to_date(F.max("txn_ts"))).scalar()
    per_band = (
        ledger.filter(F.col("status") == fv.PENDING)
        .withColumn("days", F.datediff(newest, F.to_date("txn_ts")))
        .groupBy(band(F.col("days"), fv.AGE_CUTS, fv.AGE_LABELS, inclusive=True).alias("pending_age"))
        .agg(row_count().alias("pending_txns"), F.sum("amount").alias("value"))
    )
    return per_band.select(
        "pending_age",
        "pending_txns",
        round_to(F.col("value"), 0).alias("value_in_limbo"),
        share_of_all(F.col("pending_txns"), 1).alias("pct_of_pending"),
    ).orderBy("pending_age")
