"""Significance tests, correlation, outliers and distribution tables.

Each reduces the data to a few sums or to distinct-value counts on the executors and
finishes with closed formulas on the small result.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens import fixed_values as fv
from ledgerlens.functions.exprs import binomial_tail, chi2_tail, failed, pct, ratio, round_to, row_count
from ledgerlens.operators.rfm import with_recency
from ledgerlens.plans.bins import counted_rows, exact_percentiles, items, percentile
from ledgerlens.plans.ordering import every_column


def two_proportion_ztest(
    ledger: DataFrame, focus: str = fv.FOCUS_CHANNEL, column: str = "channel", hit: Column | None = None
) -> DataFrame:
    """Failure rate of one category against all others: gap, 95 % interval, z and verdict.

    The interval uses the unpooled error, the test the pooled one. No row if a side is empty.
    """
    hit = failed() if hit is None else hit
    # A missing category is not the focus category, so it counts with the others.
    inside = F.coalesce(F.col(column) == focus, F.lit(False))
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    p1, p2 = F.col("x1") / n1, F.col("x2") / n2
    pooled = (F.col("x1") + F.col("x2")) / (n1 + n2)
    gap = p1 - p2
    error = F.sqrt(p1 * (1 - p1) / n1 + p2 * (1 - p2) / n2)
    z = ratio(gap, F.sqrt(pooled * (1 - pooled) * (1 / n1 + 1 / n2)))
    reach = fv.Z_CRITICAL_5PCT * error
    return (
        ledger.agg(
            F.count_if(inside).alias("n1"),
            F.count_if(~inside).alias("n2"),
            F.count_if(inside & hit).alias("x1"),
            F.count_if(~inside & hit).alias("x2"),
        )
        .filter((F.col("n1") > 0) & (F.col("n2") > 0))
        .select(
            round_to(100 * p1, 2).alias("focus_failure_pct"),
            round_to(100 * p2, 2).alias("other_failure_pct"),
            round_to(100 * gap, 2).alias("gap_pp"),
            round_to(100 * (gap - reach), 2).alias("ci95_low_pp"),
            round_to(100 * (gap + reach), 2).alias("ci95_high_pp"),
            round_to(z, 2).alias("z_score"),
            F.when(F.abs(z) >= fv.Z_CRITICAL_5PCT, fv.SIGNIFICANT).otherwise(fv.NOT_SIGNIFICANT).alias("conclusion"),
        )
    )


def failure_concentration_test(
    ledger: DataFrame, n_trials: int = fv.FAILURE_TRIALS, at_least: int = fv.FAILURE_THRESHOLD
) -> DataFrame:
    """Customers with repeated failures, observed against a binomial chance model."""
    per_customer = ledger.groupBy("customer_id").agg(
        F.count_if(failed()).alias("failures"), row_count().alias("rows")
    )
    totals = per_customer.agg(
        row_count().alias("customers"),
        F.count_if(F.col("failures") >= at_least).alias("observed"),
        ratio(F.sum("failures"), F.sum("rows")).alias("p"),
    )
    return totals.select(
        "customers",
        "observed",
        round_to(F.col("customers") * binomial_tail(F.col("p"), n_trials, at_least), 1).alias("expected_if_random"),
    )


def _cells(ledger: DataFrame, row: str, column: str) -> DataFrame:
    """Observed count per occurring pair with its margins; a frame of categories, not of rows."""
    counts = (
        ledger.filter(F.col(row).isNotNull() & F.col(column).isNotNull())
        .groupBy(row, column)
        .agg(row_count().alias("observed"))
    )
    rows = counts.groupBy(row).agg(F.sum("observed").alias("row_total"))
    columns = counts.groupBy(column).agg(F.sum("observed").alias("column_total"))
    n = counts.agg(F.sum("observed")).scalar()
    return counts.join(rows, row).join(columns, column).withColumn("n", n)


def chi_square_independence(
    ledger: DataFrame, row: str = "international", column: str = "risk_flag", alpha: float = fv.ALPHA
) -> DataFrame:
    """Chi-square test of two categories; a 2x2 table gets the continuity correction.

    Written so that pairs which never occur need no row: uncorrected, n * (sum of
    observed^2 / (row total * column total) - 1); in a 2x2 table every cell is equally far
    from its expectation, so one distance and the four totals are enough. Margins are plain
    aggregates, so any number of categories will do.
    """
    cells = _cells(ledger, row, column)
    product_of_totals = F.col("row_total").cast("double") * F.col("column_total")
    observed = F.col("observed").cast("double")
    # A category's 1 / total is met once per pair it occurs in; weighted by the pair's share
    # of the category it adds up to 1 / total, and the shares to the number of categories.
    summed = cells.agg(
        F.max(F.abs(observed - product_of_totals / F.col("n"))).alias("distance"),
        F.sum(observed * observed / product_of_totals).alias("fit"),
        F.max("n").cast("double").alias("n"),
        F.sum(observed / F.col("row_total") / F.col("row_total")).alias("row_inverse"),
        F.sum(observed / F.col("column_total") / F.col("column_total")).alias("column_inverse"),
        F.round(F.sum(observed / F.col("row_total"))).cast("bigint").alias("rows"),
        F.round(F.sum(observed / F.col("column_total"))).cast("bigint").alias("columns"),
    )
    corrected = F.greatest(F.lit(0.0), F.col("distance") - 0.5)
    two_by_two = F.pow(corrected, F.lit(2)) * F.col("n") * F.col("row_inverse") * F.col("column_inverse")
    tested = (
        summed.filter(F.col("n").isNotNull())
        .withColumn("dof", ((F.col("rows") - 1) * (F.col("columns") - 1)).cast("int"))
        .withColumn(
            "chi2",
            F.when(F.col("dof") == 0, F.lit(0.0))
            .when(F.col("dof") == 1, two_by_two)
            .otherwise(F.greatest(F.lit(0.0), F.col("n") * (F.col("fit") - 1))),
        )
        .withColumn("p", chi2_tail(F.col("chi2"), F.col("dof")))
    )
    return tested.select(
        round_to(F.col("chi2"), 6).alias("chi2"),
        F.col("dof").cast("bigint").alias("dof"),
        round_to(F.col("p"), 4).alias("p_value"),
        (F.col("p") < alpha).alias("significant"),
    )


def expected_counts(ledger: DataFrame, row: str = "international", column: str = "risk_flag") -> DataFrame:
    """Observed against expected count for every pair of categories, absent pairs with 0.

    The result is the full table, rows times columns: meant for category columns. Each row
    category meets the column categories in as many parts as there are shuffle partitions.
    """
    cells = _cells(ledger, row, column)
    parts = int(ledger.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = cells.groupBy(row).agg(F.max("row_total").alias("row_total"), F.max("n").alias("n"))
    columns = cells.groupBy(column).agg(F.max("column_total").alias("column_total"))
    every_part = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")
    dealt = columns.select(column, "column_total", F.pmod(F.xxhash64(column), F.lit(parts)).cast("int").alias("part"))
    expected = round_to(F.col("row_total").cast("double") * F.col("column_total") / F.col("n"), 4)
    grid = rows.select(row, "row_total", "n", every_part).join(dealt, "part")
    return (
        grid.select(row, column, expected.alias("expected"))
        .join(cells.select(row, column, "observed"), [row, column], "left")
        .select(row, column, F.coalesce("observed", F.lit(0)).cast("bigint").alias("observed"), "expected")
        .orderBy(row, column)
    )


_CORRELATED = ("txn_count", "success_rate", "flag_count", "recency_days", "value_success")


def correlation_matrix(model: DataFrame, columns: Sequence[str] = _CORRELATED) -> DataFrame:
    """Pearson correlation of customer metrics in long form; NULL against a constant column."""
    data = with_recency(model) if "recency_days" in columns and "recency_days" not in model.columns else model
    data = data.select(*[F.col(c).cast("double").alias(c) for c in columns])

    def pearson(a: str, b: str) -> Column:
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        x, y = F.when(both, F.col(a)), F.when(both, F.col(b))
        return ratio(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))

    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    one_row = data.agg(*[pearson(a, b).alias(f"{a}|{b}") for a, b in pairs])

    def cell(a: str, b: str) -> Column:
        stored = f"{a}|{b}" if columns.index(a) <= columns.index(b) else f"{b}|{a}"
        return F.struct(
            F.lit(a).alias("metric_x"), F.lit(b).alias("metric_y"), round_to(F.col(f"`{stored}`"), 6).alias("correlation")
        )

    cells = F.array(*[cell(a, b) for a, b in product(columns, repeat=2)])
    return one_row.select(F.inline(cells)).orderBy("metric_x", "metric_y")


def _iqr_bound(q1: Column, q3: Column) -> Column:
    return q3 + fv.WHISKER_IQRS * (q3 - q1)


def amount_outliers(ledger: DataFrame, value: str = "amount") -> DataFrame:
    """Mean, median, bias-adjusted skewness, upper IQR bound, rows above it, maximum; from two scans."""
    present = ledger.filter(F.col(value).isNotNull())
    found = every_column(items(present, value, [0.25, 0.5, 0.75], totals={"total": F.sum(value)}, fence_iqrs=fv.WHISKER_IQRS))
    found = found.withColumn("bound", found.agg(_iqr_bound(percentile(0.25), percentile(0.75))).scalar())
    n = F.max("all").cast("double")
    m2, m3 = F.sum("m2") / n, F.sum("m3") / n
    skewness = F.when(n > 2, F.sqrt(n * (n - 1)) / (n - 2) * ratio(m3, F.pow(m2, F.lit(1.5))))
    above = counted_rows(F.col("least") > F.col("bound"))
    return found.agg(
        round_to(ratio(F.sum("total"), n), 2).alias("mean"),
        round_to(percentile(0.5), 2).alias("median"),
        round_to(skewness, 4).alias("skewness"),
        round_to(F.max("bound"), 2).alias("upper_bound"),
        above.cast("bigint").alias("outliers"),
        pct(above, n, 1).alias("outlier_pct"),
        round_to(F.max("most"), 2).alias("maximum"),
    )


def customer_value_outliers(model: DataFrame, value: str = "value_success") -> DataFrame:
    """Customers strictly above the upper IQR bound of successful value."""
    model = every_column(model.select("customer_id", value))
    quartiles = exact_percentiles(model, value, {"q1": 0.25, "q3": 0.75})
    bound = quartiles.select(_iqr_bound(F.col("q1"), F.col("q3"))).scalar()
    return (
        model.withColumn("cutoff", bound)
        .filter(F.col(value) > F.col("cutoff"))
        .select("customer_id", round_to(F.col(value), 2).alias(value), round_to(F.col("cutoff"), 2).alias("cutoff"))
    )


def log_histogram(ledger: DataFrame, value: str = "amount", bins: int = fv.HISTOGRAM_BINS) -> DataFrame:
    """Equal-width bins of log10 over the positive amounts; the maximum belongs to the last bin."""
    logs = ledger.filter(F.col(value) > 0).select(F.log10(F.col(value).cast("double")).alias("x"))
    span = logs.agg(F.struct(F.min("x").alias("low"), F.max("x").alias("high"))).scalar()

    def with_edges(df: DataFrame) -> DataFrame:
        # A single distinct amount is given half a unit either side, as histogram tools do.
        spanned = df.withColumn("span", span)
        margin = F.when(F.col("span.low") == F.col("span.high"), 0.5).otherwise(0.0)
        low, high = F.col("span.low") - margin, F.col("span.high") + margin
        return spanned.withColumns({"low": low, "width": (high - low) / bins}).drop("span")

    slot = F.least(F.floor((F.col("x") - F.col("low")) / F.col("width")), F.lit(bins - 1)) + 1
    counts = with_edges(logs).groupBy(slot.cast("bigint").alias("bin")).agg(row_count().alias("rows"))
    every_bin = ledger.sparkSession.range(1, bins + 1).withColumnRenamed("id", "bin")
    return (
        with_edges(every_bin.join(counts, "bin", "left"))
        .select(
            "bin",
            round_to(F.col("low") + (F.col("bin") - 1) * F.col("width"), 6).alias("log10_from"),
            round_to(F.col("low") + F.col("bin") * F.col("width"), 6).alias("log10_to"),
            F.coalesce("rows", F.lit(0)).cast("bigint").alias("rows"),
        )
        .orderBy("bin")
    )


def box_stats(ledger: DataFrame, by: str = "txn_type", value: str = "amount") -> DataFrame:
    """Quartiles per type and the outermost values within 1.5 IQR of the box, by median; from two scans.

    Whiskers are read off the bins, and in the bins where a fence can lie off the values themselves.
    """
    typed = ledger.filter(F.col(by).isNotNull() & F.col(value).isNotNull())
    found = every_column(items(typed, value, [0.25, 0.5, 0.75], [by], fence_iqrs=fv.WHISKER_IQRS))
    boxes = found.groupBy(by).agg(
        percentile(0.25).alias("q1"), percentile(0.5).alias("median"), percentile(0.75).alias("q3")
    )
    reach = fv.WHISKER_IQRS * (F.col("q3") - F.col("q1"))
    return (
        found.filter(~F.col("open"))
        .join(boxes, by)
        .groupBy(by, "q1", "median", "q3")
        .agg(
            F.min(F.when(F.col("least") >= F.col("q1") - reach, F.col("least"))).alias("whisker_low"),
            F.max(F.when(F.col("most") <= F.col("q3") + reach, F.col("most"))).alias("whisker_high"),
        )
        .select(by, *[round_to(F.col(c), 4).alias(c) for c in ("q1", "median", "q3", "whisker_low", "whisker_high")])
        .orderBy("median", by)
    )
