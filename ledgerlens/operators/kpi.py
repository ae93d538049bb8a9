"""Headline figures, and the comparison that shows two paths agree."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens import fixed_values as fv
from ledgerlens.functions.exprs import flagged, is_international, pct, round_to, row_count, successful
from ledgerlens.plans.bins import items, percentile


def kpi_summary(ledger: DataFrame) -> DataFrame:
    """One row of headline figures, from two scans.

    The first gathers the bins of successful amounts, the totals and the distinct customers; the second looks at
    the bin that holds the median.
    """
    paid = F.when(successful(), F.col("amount"))
    totals = {
        "n": row_count(),
        "paid": F.count_if(successful()),
        "lost": F.count_if(F.col("status").isin(fv.FAILED, fv.REVERSED)),
        "paid_value": F.sum(paid),
        "flags": F.count_if(flagged()),
        "abroad": F.count_if(is_international()),
    }
    found = items(ledger.withColumn("_paid", paid), "_paid", [0.5], totals=totals, distinct="customer_id")
    rows = F.sum("n")
    return found.agg(
        F.coalesce(rows, F.lit(0)).cast("bigint").alias("total_transactions"),
        F.coalesce(F.max("distinct_values"), F.lit(0)).alias("active_customers"),
        pct(F.sum("paid"), rows).alias("success_rate_pct"),
        pct(F.sum("lost"), rows).alias("failed_or_reversed_pct"),
        round_to(F.sum("paid_value"), 0).alias("successful_value"),
        round_to(percentile(0.5), 0).alias("median_successful"),
        pct(F.sum("flags"), rows).alias("review_rate_pct"),
        pct(F.sum("abroad"), rows).alias("international_share_pct"),
    )


def reconcile(left: DataFrame, right: DataFrame, keys: Sequence[str], tolerance: float = 0.0) -> DataFrame:
    """Compare the same figures from two independent paths, one row per key and measure.

    Both frames share their key and measure columns. A key or value only one side has does
    not match; values missing on both sides do.
    """
    measures = [c for c in left.columns if c not in keys]
    if set(measures) != set(right.columns) - set(keys):
        raise ValueError("both sides need the same measure columns")

    def long(df: DataFrame, side: str) -> DataFrame:
        cells = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias(side)) for m in measures])
        return df.select(F.struct(*keys).alias("key"), F.inline(cells)).withColumn(f"in_{side}", F.lit(True))

    both = long(left, "left_value").join(long(right, "right_value"), ["key", "measure"], "full")
    close = F.abs(F.col("left_value") - F.col("right_value")) <= tolerance
    neither = F.col("left_value").isNull() & F.col("right_value").isNull()
    present = F.col("in_left_value").isNotNull() & F.col("in_right_value").isNotNull()
    return both.select(
        *[F.col("key")[k].alias(k) for k in keys],
        "measure",
        "left_value",
        "right_value",
        (present & F.coalesce(close, neither)).alias("matches"),
    )


RANGES = 512


def _digests(df: DataFrame, columns: Sequence[str]) -> list[Column]:
    """Two hashes of a row that tell a missing value from any other."""
    parts = [p for c in columns for p in (F.col(c).isNull(), F.col(c))]
    return [F.xxhash64(F.lit(seed), *parts) for seed in (1, 2)]


def range_splits(df: DataFrame, key: str, ranges: int = RANGES) -> list:
    """Keys that cut df into about `ranges` ranges of similar size; the driver gets no more than twice as many."""
    keys = df.select(key).filter(F.col(key).isNotNull())
    one_in = max(1, keys.count() // (8 * ranges))
    sample = keys.filter(F.pmod(F.xxhash64(key), F.lit(one_in)) == 0).distinct()
    order = F.row_number().over(Window.orderBy(key))  # of the sample, some 8 keys a range
    held = sample.withColumn("n", order).filter(F.col("n") % 8 == 0).orderBy(key).limit(2 * ranges)
    return [r[key] for r in held.collect()]


def _with_range(df: DataFrame, key: str, splits: Sequence) -> DataFrame:
    """df with `_range`, the number of the range a key lies in: 0 below the first split, -1 for a missing key."""
    kind = df.schema[key].dataType.simpleString()
    held = df.sparkSession.createDataFrame([(list(splits),)], f"s array<{kind}>").select("s").scalar()
    found = df.withColumns({"_splits": held, "_range": F.when(F.col(key).isNull(), -1).otherwise(0)})
    for bit in reversed(range(len(splits).bit_length())):  # a projection per step keeps it in generated code
        at, step = F.col("_range"), 2**bit
        beyond = F.get(F.col("_splits"), at + (step - 1)) <= F.col(key)
        found = found.withColumn("_range", F.when(beyond, at + step).otherwise(at))
    return found.drop("_splits")


def differing_ranges(left: DataFrame, right: DataFrame, key: str, splits: Sequence) -> list[int]:
    """The key ranges of which the two sides hold different rows, whatever their order.

    One scan of each side with a row per range and task: rows and the sums of two row hashes."""
    sides = []
    for df, side in ((left, "a"), (right, "b")):
        first, second = _digests(df, left.columns)
        sums = [F.sum(h.cast("decimal(20,0)")) for h in (first, second)]
        sides.append(_with_range(df, key, splits).groupBy("_range").agg(F.struct(row_count(), *sums).alias(side)))
    joined = sides[0].join(sides[1], "_range", "full").filter(~F.col("a").eqNullSafe(F.col("b")))
    return sorted(r["_range"] for r in joined.select("_range").collect())


def in_ranges(df: DataFrame, key: str, splits: Sequence, numbers: Sequence[int]) -> DataFrame:
    """The rows of df in these key ranges, by comparisons that a scan can skip files and row groups with."""
    parts, merged = [], []
    for n in sorted(numbers):  # neighbours become one range
        if merged and n >= 0 and merged[-1][1] == n - 1 and merged[-1][0] >= 0:
            merged[-1][1] = n
        else:
            merged.append([n, n])
    for first, last in merged:
        if first < 0:
            parts.append(F.col(key).isNull())
            continue
        part = F.col(key).isNotNull()
        part = part & (F.col(key) >= splits[first - 1]) if first else part
        parts.append(part & (F.col(key) < splits[last]) if last < len(splits) else part)
    return df.filter(reduce(lambda a, b: a | b, parts)) if parts else df.limit(0)


def reconcile_rows(left: DataFrame, right: DataFrame, key: str, ranges: int = RANGES) -> DataFrame:
    """Rows that only one of two tables of the same columns holds, by key.

    Checksums that do not depend on order are compared per range of keys; only the ranges that differ are read
    again, on both sides, and there rows are compared by key. On tables stored in key order a changed row costs
    one range. Result: the key, `status` (changed, only_left, only_right), rows of the key on each side that the
    other lacks, and for a single changed row the names of the `columns` that differ. Equal rows are told apart
    by number; the result has no rows where the tables agree."""
    if dict(left.dtypes) != dict(right.dtypes):
        raise ValueError("both sides need the same columns of the same types")
    splits = range_splits(left, key, ranges)
    numbers = differing_ranges(left, right, key, splits)
    sides = []
    for df, side in ((left, "left"), (right, "right")):
        row = F.struct(*[F.col(c) for c in left.columns])
        near = in_ranges(df, key, splits, numbers).groupBy(row.alias("row")).agg(row_count().alias(side))
        sides.append(near)
    same = sides[0]["row"].eqNullSafe(sides[1]["row"])
    both = sides[0].join(sides[1], same, "full").select(
        F.coalesce(sides[0]["row"], sides[1]["row"]).alias("row"),
        F.coalesce("left", F.lit(0)).alias("l"),
        F.coalesce("right", F.lit(0)).alias("r"),
    )
    extra = both.filter("l <> r").select(
        F.col("row")[key].alias("_key"),
        F.greatest(F.col("l") - F.col("r"), F.lit(0)).alias("l"),
        F.greatest(F.col("r") - F.col("l"), F.lit(0)).alias("r"),
        *[F.col("row")[c].alias(c) for c in left.columns],
    )
    others = [c for c in left.columns if c != key]

    def of(side: str, column: str) -> Column:
        return F.max(F.when(F.col(side) > 0, F.col(column)))

    changed = F.array_compact(F.array(*[F.when(~of("l", c).eqNullSafe(of("r", c)), F.lit(c)) for c in others]))
    only_l, only_r = F.sum("l"), F.sum("r")
    return extra.groupBy("_key").agg(
        F.when(only_r == 0, "only_left").when(only_l == 0, "only_right").otherwise("changed").alias("status"),
        only_l.cast("bigint").alias("left_rows"),
        only_r.cast("bigint").alias("right_rows"),
        F.when((only_l == 1) & (only_r == 1), F.array_join(changed, ",")).alias("columns"),
    ).withColumnRenamed("_key", key)


def kpi_parts(ledger: DataFrame) -> DataFrame:
    """The KPI row's totals in full precision: rows, successful rows and successful value."""
    paid = successful()
    return ledger.agg(
        row_count().cast("double").alias("total_transactions"),
        F.count_if(paid).cast("double").alias("successful_transactions"),
        F.sum(F.when(paid, F.col("amount"))).cast("double").alias("successful_value"),
    ).select(F.lit("all").alias("scope"), "*")


def kpi_parts_by_status_and_type(ledger: DataFrame) -> DataFrame:
    """The same totals added up from the status shares and the values by type."""
    paid = successful()
    by_pair = ledger.groupBy("status", "txn_type").agg(row_count().alias("rows"), F.sum("amount").alias("value"))
    return by_pair.agg(
        F.sum("rows").cast("double").alias("total_transactions"),
        F.sum(F.when(paid, F.col("rows"))).cast("double").alias("successful_transactions"),
        F.sum(F.when(paid, F.col("value"))).cast("double").alias("successful_value"),
    ).select(F.lit("all").alias("scope"), "*")
