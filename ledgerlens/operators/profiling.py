"""Structure and integrity checks of the two tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.functions.exprs import ratio, round_to, row_count
from ledgerlens.plans.bins import items, percentile


def relationship_check(ledger: DataFrame, accounts: DataFrame) -> DataFrame:
    """Record counts, transactions without a customer and customers without a transaction.

    One full outer join of per-key counts answers both directions with one pass per table;
    a missing key matches nothing and counts as unmatched.
    """
    txns = ledger.groupBy("customer_id").agg(row_count().alias("txns"))
    owners = accounts.groupBy("customer_id").agg(row_count().alias("owners"))
    both = txns.join(owners, "customer_id", "full")

    def total(column: str, condition: Column | None = None) -> Column:
        counted = F.col(column) if condition is None else F.when(condition, F.col(column))
        return F.coalesce(F.sum(counted), F.lit(0)).cast("bigint")

    return both.agg(
        total("owners").alias("customer_records"),
        total("txns").alias("transaction_records"),
        total("txns", F.col("owners").isNull()).alias("orphan_transactions"),
        total("owners", F.col("txns").isNull()).alias("customers_without_transactions"),
    )


def profile_shape(df: DataFrame) -> DataFrame:
    """Rows, columns, and per column its type and non-missing count, in column order."""
    counts = [
        F.struct(
            F.lit(i).cast("bigint").alias("position"),
            F.lit(name).alias("column_name"),
            F.lit(kind).alias("data_type"),
            F.count(name).alias("non_null"),
        )
        for i, (name, kind) in enumerate(df.dtypes, start=1)
    ]
    one_row = df.agg(
        row_count().alias("row_total"), F.lit(len(df.columns)).cast("bigint").alias("column_total"), F.array(*counts).alias("c")
    )
    return one_row.select("row_total", "column_total", F.inline("c")).orderBy("position")


def profile_nulls(df: DataFrame) -> DataFrame:
    """Missing values per column and in the whole frame, in one pass."""
    nulls = [
        F.struct(F.lit(c).alias("column_name"), F.count_if(F.col(c).isNull()).alias("nulls")) for c in df.columns
    ]
    total = F.aggregate("c", F.lit(0).cast("bigint"), lambda acc, x: acc + x["nulls"])
    return df.agg(F.array(*nulls).alias("c")).select(total.alias("frame_nulls"), F.inline("c")).orderBy("column_name")


_MARKS = 1 << 20


def _row_digest(df: DataFrame, seed: int) -> Column:
    """A hash of a row that tells a missing value from any other."""
    parts = [p for c in df.columns for p in (F.col(c).isNull(), F.col(c))]
    return F.xxhash64(F.lit(seed), *parts)


def profile_duplicates(df: DataFrame) -> DataFrame:
    """Fully equal rows beyond the first.

    The first scan counts 128-bit digests of rows, so its shuffle does not depend on how wide a row is. The digests
    that repeat set marks in a table of fixed size; the second scan compares rows in full, but only those with a mark,
    and combines copies before the shuffle. A mark set by another row lets a row through that adds nothing.
    """
    first, second = _row_digest(df, 1), _row_digest(df, 2)
    digests = df.select(first.alias("a"), second.alias("b")).groupBy("a", "b").agg(row_count().alias("n"))
    mark = F.pmod(F.col("a"), F.lit(_MARKS))
    words = (
        digests.filter("n > 1")
        .groupBy(F.floor(mark / 64).alias("word"))
        .agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(a, {_MARKS}) % 64 as int))")).alias("bits"))
    )
    table = F.map_from_entries(F.collect_list(F.struct("word", "bits")))  # at most _MARKS / 64 entries
    by_word = words.agg(table.alias("m")).select(
        F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(_MARKS // 64 - 1).cast("bigint")), lambda w: F.coalesce(F.try_element_at("m", w), F.lit(0).cast("bigint")))
    )
    own = F.pmod(first, F.lit(_MARKS))
    bits = F.get("_marks", F.floor(own / 64).cast("int"))
    marked = df.withColumn("_marks", by_word.scalar()).filter(F.getbit(bits, (own % 64).cast("int")) == 1).drop("_marks")
    copies = marked.groupBy(*df.columns).agg(row_count().alias("copies"))
    return copies.agg(F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).cast("bigint").alias("duplicate_rows"))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def profile_describe(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Count, mean, sample deviation, extremes and exact quartiles of every numeric column."""
    columns = numeric_columns(df) if columns is None else list(columns)
    pairs = F.array(
        *[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("x")) for c in columns]
    )
    long = df.select(F.inline(pairs)).filter(F.col("x").isNotNull())
    found = items(long, "x", [0.25, 0.5, 0.75], ["column_name"], {"total": F.sum("x"), "n": row_count()})
    n = F.sum("n")
    return (
        found.groupBy("column_name")
        .agg(
            n.alias("count"),
            ratio(F.sum("total"), n).alias("mean"),
            F.when(n > 1, F.sqrt(ratio(F.sum("m2"), n - 1))).alias("std"),
            F.min("least").alias("min"),
            *[percentile(q / 100).alias(f"p{q}") for q in (25, 50, 75)],
            F.max("most").alias("max"),
        )
        .select(
            "column_name",
            "count",
            round_to(F.col("mean"), 4).alias("mean"),
            round_to(F.col("std"), 4).alias("std"),
            "min",
            "p25",
            "p50",
            "p75",
            "max",
        )
        .orderBy("column_name")
    )


def merge_left_check(ledger: DataFrame, accounts: DataFrame) -> DataFrame:
    """Shape and missing values of transactions left-joined to customers.

    The wide join itself is never built: missing values add up per customer on the left
    and per account row on the right, weighted by the transactions they meet.
    """

    def nulls(columns: Sequence[str]) -> Column:
        return sum((F.col(c).isNull().cast("bigint") for c in columns), F.lit(0).cast("bigint"))

    right_columns = [c for c in accounts.columns if c != "customer_id"]
    left = ledger.groupBy("customer_id").agg(row_count().alias("rows"), F.sum(nulls(ledger.columns)).alias("nulls"))
    right = accounts.select("customer_id", nulls(right_columns).alias("right_nulls"))
    met = left.join(right, "customer_id", "left")
    missing = F.col("nulls") + F.col("rows") * F.coalesce("right_nulls", F.lit(len(right_columns)).cast("bigint"))
    return met.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).cast("bigint").alias("row_total"),
        F.lit(len(ledger.columns) + len(right_columns)).cast("bigint").alias("column_total"),
        F.coalesce(F.sum(missing), F.lit(0)).cast("bigint").alias("null_total"),
    )
