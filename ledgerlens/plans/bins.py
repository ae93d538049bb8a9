"""Exact order statistics and moments from mergeable bins of a value.

The first scan counts the rows of each bin of a rising function of the value, with its least and greatest value,
its moments and any totals the caller wants; all of them merge, so a task sends one row per bin and group.
Running counts over these few rows tell which bins hold the wanted ranks and, where fences are asked for, which
bins they can fall into. The second scan looks only at the rows of those bins, and of bins of one value at none.
Everything else, counts beyond a fence, extremes, means, is read off the bins. The bins bound the work and never
touch a result.

`items` gives both together, one row per bin and one per value in a bin that was looked into; the figures are
aggregates over it.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.plans.ordering import every_column, last, running_totals

BINS_PER_E_FOLD = 64


def bin_of(x: Column) -> Column:
    """The number of a value's bin, rising with it; NULL for NULL."""
    return F.floor(F.signum(x) * F.log1p(F.abs(x)) * BINS_PER_E_FOLD)


def group_keys(by: Sequence[str]) -> dict[str, Column]:
    """Columns that join groups; a missing group is one of its own."""
    return {f"_g{i}": F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for i, c in enumerate(by)}


def _held(ranks: Column) -> Column:
    return F.exists(ranks, lambda r: (r >= F.col("start")) & (r < F.col("start") + F.col("rows")))


def _position(q: float) -> Column:
    return (F.col("all") - 1) * F.lit(float(q))


def items(
    df: DataFrame,
    value: str,
    quantiles: Sequence[float],
    by: Sequence[str] = (),
    totals: Mapping[str, Column] | None = None,
    fence_iqrs: float | None = None,
    distinct: str | None = None,
) -> DataFrame:
    """One row per bin and one per value of the bins looked into.

    `rows` (with a value), `start` (rows before them), `all` (of the group), `least`, `most`, and `value` where
    they are equal. `open` marks the bins whose values follow as rows of their own. Rows of bins also have the
    group's `mean`, `m2` and `m3` (the bin's part of the sums of squares and cubes about it) and the caller's
    `totals` (aggregates over df that are sums); all of these are NULL in rows of values. The values of `distinct`
    are gathered by the first scan too, and every item has their number as `distinct_values`.

    `by` is for category columns: what is broadcast has a few rows per quantile, fence and category.
    """
    x = F.col(value).cast("double")
    rows = df.withColumns({"_x": x, "_bin": bin_of(x)})
    keys, first = [*by, "_bin"], rows
    if distinct is not None:
        marks = F.array(
            F.struct(F.lit(False).alias("_own"), F.lit(None).cast(df.schema[distinct].dataType).alias("_d")),
            F.struct(F.lit(True).alias("_own"), F.col(distinct).alias("_d")),
        )
        blank = {c: F.when(~F.col("_own"), F.col(c)) for c in (*keys, "_x")}
        keys, first = [*keys, "_own", "_d"], rows.select("*", F.inline(marks)).withColumns(blank)
    bins = first.groupBy(*keys).agg(
        F.count("_x").alias("rows"),
        F.min("_x").alias("least"),
        F.max("_x").alias("most"),
        F.avg("_x").alias("_mean"),
        F.var_pop("_x").alias("_var"),
        F.skewness("_x").alias("_skew"),
        *[c.alias(name) for name, c in (totals or {}).items()],
    )
    bins, seen = every_column(bins), F.lit(None).cast("bigint")
    if distinct is not None:
        own = F.when(F.col("rows") >= 0, F.col("_own"))  # not pushed below the aggregate, which both sides share
        seen = bins.filter(own).agg(F.count("_d")).scalar()
        bins = bins.filter(~own).drop("_own", "_d")
    whole = Window.partitionBy(*by)
    n = F.col("rows")
    bins = bins.withColumns(
        {
            "start": F.sum("rows").over(whole.orderBy("_bin")) - n,
            "all": F.sum("rows").over(whole),
            "mean": F.try_divide(F.sum(n * F.col("_mean")).over(whole), F.sum("rows").over(whole)),
        }
    )
    # Moments about the bin's own mean, moved to the group's: no digits are lost far from zero.
    d, own = F.col("_mean") - F.col("mean"), F.col("_var") * n
    skew = F.when(F.col("_var") > 0, F.nanvl(F.col("_skew"), F.lit(0.0))).otherwise(F.col("_var"))
    third = skew * n * F.pow(F.col("_var"), F.lit(1.5))
    bins = bins.withColumns({"m2": own + n * d * d, "m3": third + 3 * d * own + n * d * d * d})

    near = _held(F.array_distinct(F.array(*[f(_position(q)) for q in quantiles for f in (F.floor, F.ceil)])))
    if fence_iqrs is not None:

        def edge(q: float, rank, side: str) -> Column:
            return F.max(F.when(_held(F.array(rank(_position(q)))), F.col(side))).over(whole)

        q1 = edge(0.25, F.floor, "least"), edge(0.25, F.ceil, "most")
        q3 = edge(0.75, F.floor, "least"), edge(0.75, F.ceil, "most")
        k = F.lit(float(fence_iqrs))
        low = q1[0] - k * (q3[1] - q1[0]), q1[1] - k * (q3[0] - q1[1])
        high = q3[0] + k * (q3[0] - q1[1]), q3[1] + k * (q3[1] - q1[0])
        # A hair of room, so that rounding in these bounds cannot leave a bin out.
        room = F.abs(F.col("least")) * 1e-9 + F.abs(F.col("most")) * 1e-9
        meets = [(F.col("least") - room <= hi) & (F.col("most") + room >= lo) for lo, hi in (low, high)]
        near = near | meets[0] | meets[1]
    bins = bins.withColumn("open", F.coalesce(near & (F.col("least") < F.col("most")), F.lit(False)))

    # A few bins per quantile, fence and group.
    keys = group_keys(by)
    wanted = bins.filter("open").select(
        *[c.alias(k) for k, c in keys.items()], F.col("_bin").alias("_b"), F.col("start").alias("before"), "all"
    )
    looked = rows.withColumns(keys).withColumn("_b", F.col("_bin")).join(F.broadcast(wanted), [*keys, "_b"])
    counted = looked.groupBy(*by, "before", "all", F.col("_x").alias("value")).agg(F.count(F.lit(1)).alias("rows"))
    placed = running_totals(counted, ["value"], ["rows"], [*by, "before"])
    values = placed.select(
        *by, "value", "rows", (F.col("before") + F.col("rows_to") - F.col("rows")).alias("start"), "all",
        F.col("value").alias("least"), F.col("value").alias("most"), F.lit(False).alias("open"),
    )
    single = F.when(F.col("least") == F.col("most"), F.col("least")).alias("value")
    shown = ["rows", "start", "all", "least", "most", "open", "mean", "m2", "m3", *(totals or {})]
    both = bins.select(*by, single, *shown).unionByName(values, allowMissingColumns=True)
    return both if distinct is None else both.withColumn("distinct_values", seen)


def percentile(q: float) -> Column:
    """Aggregate over the items of a group: the percentile with linear interpolation."""

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("start") <= rank) & (rank < F.col("start") + F.col("rows")), F.col("value")))

    low, high = at(F.floor(_position(q))), at(F.ceil(_position(q)))
    return low + (high - low) * F.max(_position(q) - F.floor(_position(q)))


def counted_rows(condition: Column | None = None) -> Column:
    """Aggregate over items: rows that meet a condition on `least` and `most`, which no open bin is needed for."""
    inside = ~F.col("open") if condition is None else ~F.col("open") & condition
    return F.coalesce(F.sum(F.when(inside, F.col("rows"))), F.lit(0))


def exact_percentiles(df: DataFrame, value: str, quantiles: Mapping[str, float], by: Sequence[str] = ()) -> DataFrame:
    """One row per group with each named quantile of the non-NULL values, linearly interpolated."""
    found = items(df.filter(F.col(value).isNotNull()), value, list(quantiles.values()), by)
    return found.groupBy(*by).agg(*[percentile(q).alias(name) for name, q in quantiles.items()])


def counted_tiles(
    df: DataFrame,
    value: str,
    tiebreak: str,
    measures: Mapping[str, Column],
    ranks: Callable[[Column], list[Column]],
) -> DataFrame:
    """Rows, value and measures of each tile of the rows by falling `value`, NULL last.

    One row per tile and bin or key that a cut divides, for the caller to add up: `tile`, `rows`, `total` and
    `least` (of the value) and the measures (whole numbers per row). The first scan counts rows, total, least
    value and measures per bin; the second orders the rows of the few bins that a cut divides, by value and
    `tiebreak` (NULL last). Fully equal rows are one item and, being interchangeable, are divided by number, so
    neither a hot value nor a hot row fills a slice.
    """
    names = list(measures)
    amount = F.col(value)
    rows = df.select(
        amount.alias("value"), F.col(tiebreak).alias("id"), *[c.alias(m) for m, c in measures.items()],
        bin_of(amount.cast("double")).alias("bin"),
    )
    bins = rows.groupBy("bin").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum("value").alias("total"),
        F.min("value").alias("least"),
        *[F.sum(m).alias(m) for m in names],
    )
    bins = every_column(bins)
    falling = Window.orderBy(F.col("bin").desc_nulls_last())
    bins = bins.withColumn("start", F.sum("rows").over(falling) - F.col("rows"))
    cuts = F.array(*ranks(F.sum("rows").over(Window.partitionBy())))
    bins = bins.withColumn("cuts", cuts)
    end = F.col("start") + F.col("rows")
    bins = bins.withColumn("divided", F.exists("cuts", lambda c: (c > F.col("start")) & (c < end)))

    tile = F.size(F.filter("cuts", lambda c: c < end)) + 1
    whole = bins.filter(~F.col("divided")).select(tile.alias("tile"), "least", "rows", "total", *names)
    # No more divided bins than cuts.
    divided = bins.filter("divided").select(F.col("bin").alias("cut_bin"), F.col("start").alias("before"), "cuts")
    none, down = last(-F.col("value"))
    id_none, row = last(F.col("id"))
    keys = {"none": none, "down": down, "id_none": id_none, "row": row}
    held = rows.join(F.broadcast(divided), F.col("bin").eqNullSafe(F.col("cut_bin"))).withColumns(keys)
    ties = held.groupBy("before", "cuts", "value", *keys, *names).agg(F.count(F.lit(1)).alias("rows"))
    placed = running_totals(ties, [*keys, *names], ["rows"], ["before"])
    first, end = F.col("before") + F.col("rows_to") - F.col("rows"), F.col("before") + F.col("rows_to")
    edges = F.concat(F.array(F.lit(0).cast("bigint")), "cuts", F.array(F.lit(2**62)))
    pieces = F.transform(
        F.sequence(F.lit(1), F.size("cuts") + 1),
        lambda t: F.struct(
            t.alias("tile"),
            (F.least(end, F.get(edges, t)) - F.greatest(first, F.get(edges, t - 1))).alias("n"),
        ),
    )
    parted = placed.select("value", *names, F.inline(pieces)).filter("n > 0")
    parted = parted.select(
        "tile", F.col("value").alias("least"), F.col("n").alias("rows"), (F.col("value") * F.col("n")).alias("total"),
        *[(F.col(m) * F.col("n")).alias(m) for m in names],
    )
    return whole.unionByName(parted)
