"""Exact ranks, percentiles and running totals without sorting everything in one task.

A window with no partition key moves every row to a single task. The functions here
get the same numbers from three bounded steps:

1. Split points. A hash-selected sample of the ordering keys, sorted and thinned, cuts
   the key range into about `bucket_count` slices of similar size. It only balances the
   work; results never depend on which keys were drawn.
2. Slice totals. One map-side aggregation to a row per slice, then a window over those
   few rows gives what lies before each slice.
3. Inside a slice, an ordinary window adds the local part.

Ordering keys have to be unique within their group. Callers get there by aggregating
equal values first (`value_counts`) or by adding the row id to the key, so a value held
by a third of all rows never forces them into one slice.

NULL sorts last, ascending and descending, as SQL engines rank it by default: `last`
gives the key parts for that. Building a plan starts no job.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SAMPLES_PER_BUCKET = 16


def bucket_count(spark: SparkSession) -> int:
    """Two slices per shuffle partition, so slices grow in number with the cluster's settings."""
    return 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def last(key: Column) -> tuple[Column, Column]:
    """Two key parts that sort `key` ascending with NULL last (struct order alone puts it first)."""
    return key.isNull(), key


def every_column(df: DataFrame) -> DataFrame:
    """df through a condition that always holds and reads each column.

    A subquery over it keeps the columns of the main plan, so both read one shuffle output
    instead of scanning the input twice.
    """
    return df.filter(F.pmod(F.xxhash64(*df.columns), F.lit(2)) < 2)


def _with_bucket(items: DataFrame, order: Sequence[str]) -> DataFrame:
    """Add `_bucket`: how many split points lie strictly below the row's ordering key."""
    key = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    buckets = bucket_count(items.sparkSession)
    # Hashing the whole row keeps every subquery on the columns of the main plan, so all
    # of them read the same shuffle output instead of rescanning the input.
    row_hash = F.xxhash64(*items.columns)
    row_total = items.agg(F.count_if(row_hash != 0)).scalar()
    one_in = F.greatest(F.lit(1).cast("bigint"), F.floor(row_total / (buckets * SAMPLES_PER_BUCKET)))
    sample = items.filter(F.pmod(row_hash, one_in) == 0).agg(F.sort_array(F.collect_set(key)).alias("keys"))
    stride = F.greatest(F.lit(1), F.floor(F.size("keys") / buckets).cast("int"))
    splits = sample.select(F.filter("keys", lambda _, i: i % stride == stride - 1)).scalar()

    # Binary search in steps of falling powers of two; an index past the end reads NULL,
    # which is not below anything. One fold names each column once: with a projection per step,
    # the optimizer puts every step into the next one three times over when it follows `_bucket`
    # down the plan, and the plan outgrows the driver as the slices grow in number.
    found = items.withColumns({"_splits": splits, "_key": key})

    def step(at: Column, size: Column) -> Column:
        beyond = F.get(F.col("_splits"), at + size - 1) < F.col("_key")
        return F.when(beyond, at + size).otherwise(at)

    sizes = F.array(*[F.lit(2**bit) for bit in reversed(range((4 * buckets).bit_length()))])
    # Never NULL, and said so: else joins on it push a test for NULL below the shuffle, which is then not shared.
    found = found.withColumn("_bucket", F.coalesce(F.aggregate(sizes, F.lit(0), step), F.lit(0)))
    return found.drop("_splits", "_key")


def running_totals(
    items: DataFrame, order: Sequence[str], measures: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """Add `<m>_to` (total of m up to and including the row) and `<m>_all` (group total).

    Rows are ordered ascending by `order`, unique within `by`. A group of any size is shared
    out over the slices, and the slice offsets are joined on the partitioning the inner
    window already has.
    """
    # A missing group is a group of its own: spelled out, because a join drops NULL keys.
    named = {f"_group{i}": F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for i, c in enumerate(by)}
    bucketed = _with_bucket(items, order).withColumns(named) if by else _with_bucket(items, order)
    slot = ["_bucket", *named]

    slices = bucketed.groupBy(*slot).agg(*[F.sum(m).alias(m) for m in measures])
    whole = Window.partitionBy(*named)
    offsets = slices.select(
        *slot,
        *[(F.sum(m).over(whole.orderBy("_bucket")) - F.col(m)).alias(f"{m}_before") for m in measures],
        *[F.sum(m).over(whole).alias(f"{m}_all") for m in measures],
    )
    inside = Window.partitionBy(*slot).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = bucketed.select("*", *[F.sum(m).over(inside).alias(f"{m}_inside") for m in measures])
    return local.join(offsets, slot).select(
        *items.columns,
        *[(F.col(f"{m}_before") + F.col(f"{m}_inside")).alias(f"{m}_to") for m in measures],
        *[F.col(f"{m}_all") for m in measures],
    )


def distinct_values(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Each non-NULL value per group once, as `value`, with its `rows` and `total`.

    Equal values are combined before the shuffle: a hot value costs one row per map task.
    """
    return (
        df.select(*by, F.col(value).alias("value"))
        .filter(F.col("value").isNotNull())
        .groupBy(*by, "value")
        .agg(F.count(F.lit(1)).alias("rows"))
        .withColumn("total", F.col("value") * F.col("rows"))
    )


def value_counts(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """`distinct_values` with running and group totals (`rows_to`, `rows_all`, `total_all`).

    The input is scanned once; exact percentiles and moments read off the result.
    """
    return running_totals(distinct_values(df, value, by), ["value"], ["rows", "total"], by)


def percentile(q: float) -> Column:
    """Aggregate over `value_counts` rows: the percentile with linear interpolation."""
    position = (F.col("rows_all") - 1) * F.lit(float(q))
    starts_at = F.col("rows_to") - F.col("rows")

    def at(index: Column) -> Column:
        return F.max(F.when((starts_at <= index) & (index < F.col("rows_to")), F.col("value"))).cast("double")

    low, high = at(F.floor(position)), at(F.ceil(position))
    return low + (high - low) * F.max(position - F.floor(position))


def ntile_ranks(tiles: int) -> Callable[[Column], list[Column]]:
    """Last rank of each tile but the final one when n rows go into equal tiles, larger ones first."""

    def ranks(n: Column) -> list[Column]:
        size, spare = F.floor(n / tiles), n % tiles
        return [size * tile + F.least(F.lit(tile), spare) for tile in range(1, tiles)]

    return ranks


def quantile_ranks(tiles: int) -> Callable[[Column], list[Column]]:
    """Last rank at or below each inner quantile edge of the ranks 1..n."""

    def ranks(n: Column) -> list[Column]:
        return [F.floor(F.lit(1.0) + (n - 1) * F.lit(tile / tiles)) for tile in range(1, tiles)]

    return ranks


def fraction_ranks(*fractions: float) -> Callable[[Column], list[Column]]:
    """Rank of the last row inside each leading fraction of n rows, rounded down."""
    return lambda n: [F.floor(n * F.lit(fraction)) for fraction in fractions]


def with_tiles(
    df: DataFrame,
    tiles: Mapping[str, Column],
    tiebreak: str,
    ranks: Callable[[Column], list[Column]],
) -> DataFrame:
    """Add one tile number per entry of `tiles`, counting from 1 in ascending (sort value, tiebreak).

    NULL sorts last in both. `ranks` gives the last rank of each tile but the final one. Only
    the rows at those ranks are looked up and every row is compared with those few keys where
    it stands, so the input itself is neither sorted nor shuffled. All sort values need one
    common type. `tiebreak` identifies a row, as after grouping by it; where it does not,
    `unique_rows` numbers the copies first.
    """
    cut_count = len(ranks(F.lit(1)))
    names = list(tiles)

    def key(sort_value: Column) -> Column:
        none, at = last(sort_value)
        id_none, row = last(F.col(tiebreak))
        return F.struct(none.alias("none"), at.alias("at"), id_none.alias("id_none"), row.alias("id"))

    keys = {name: key(sort_value) for name, sort_value in tiles.items()}
    parts = ["none", "at", "id_none", "id"]

    entries = F.array(*[F.struct(F.lit(i).alias("metric"), keys[name].alias("key")) for i, name in enumerate(names)])
    items = df.select(F.inline(entries)).select("metric", *[F.col(f"key.{p}").alias(p) for p in parts])
    bucketed = _with_bucket(items, parts)

    slices = bucketed.groupBy("metric", "_bucket").agg(F.count(F.lit(1)).alias("rows"))
    whole = Window.partitionBy("metric")
    wanted = (
        slices.withColumn("all", F.sum("rows").over(whole))
        .withColumn("to", F.sum("rows").over(whole.orderBy("_bucket")))
        .select("metric", "_bucket", "rows", "to", F.posexplode(F.array(*ranks(F.col("all")))).alias("cut", "rank"))
        .filter((F.col("rank") > F.col("to") - F.col("rows")) & (F.col("rank") <= F.col("to")))
        .groupBy("metric", "_bucket")
        .agg(F.collect_list(F.struct("cut", (F.col("rank") - F.col("to") + F.col("rows")).alias("nth"))).alias("cuts"))
    )
    # At most len(tiles) * cut_count rows, both fixed by the call.
    nth = F.row_number().over(Window.partitionBy("metric", "_bucket").orderBy(*parts))
    found = (
        bucketed.join(F.broadcast(wanted), ["metric", "_bucket"])
        .withColumn("n", nth)
        .select("metric", *parts, "n", F.inline("cuts"))
        .filter(F.col("n") == F.col("nth"))
    )
    slot = F.col("metric") * cut_count + F.col("cut")
    by_slot = found.agg(F.map_from_entries(F.collect_list(F.struct(slot, F.struct(*parts)))).alias("by_slot"))
    every_slot = F.sequence(F.lit(0), F.lit(len(names) * cut_count - 1))
    cuts = by_slot.select(F.transform(every_slot, lambda i: F.try_element_at("by_slot", i))).scalar()

    def tile(metric: int) -> Column:
        number = F.lit(1)
        for cut in range(cut_count):
            # No row at this rank means the rank is 0: every row lies after it.
            after = keys[names[metric]] > F.get("_cuts", F.lit(metric * cut_count + cut))
            number = number + F.coalesce(after, F.lit(True)).cast("int")
        return number

    # Held in a column, so the lookup is planned once however many cuts refer to it.
    with_cuts = df.withColumn("_cuts", cuts)
    return with_cuts.withColumns({name: tile(i) for i, name in enumerate(names)}).drop("_cuts")


def unique_rows(df: DataFrame, identity: str, name: str = "_copy") -> tuple[DataFrame, str]:
    """df with a column that tells the rows of one `identity` apart, usable as a tiebreak."""
    copy = F.row_number().over(Window.partitionBy(identity).orderBy(*[c for c in df.columns if c != identity]))
    return df.withColumn(name, F.struct(F.col(identity).isNull(), F.col(identity), copy)), name
