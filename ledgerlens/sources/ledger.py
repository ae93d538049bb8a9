"""Load, clean and store the two ledger tables under canonical column names."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens import fixed_values as fv
from ledgerlens.functions.exprs import flagged, month_label, successful
from ledgerlens.operators import rfm

_TYPES: dict[str, T.DataType] = {"txn_ts": T.TimestampNTZType(), "amount": T.DecimalType(18, 2)}


def csv_schema(
    headers: Iterable[str], names: Mapping[str, str], overrides: Mapping[str, T.DataType] | None = None
) -> T.StructType:
    """Explicit schema for a header row: text, except timestamps and amounts.

    Yes/No columns therefore stay text. Amounts are decimals, so a sum does not depend on
    the order of its rows or on a task being run again. `overrides` gives another type per
    canonical name, e.g. `{"customer_id": LongType()}`.
    """
    types = {**_TYPES, **(overrides or {})}
    return T.StructType([T.StructField(h, types.get(names.get(h, h), T.StringType())) for h in headers])


#: Types a text column may have, from the narrowest; text takes any value.
INFERRED: tuple[T.DataType, ...] = (T.LongType(), T.DoubleType(), T.TimestampNTZType())

#: What a text looks like if a cast to the type may take it. A cast of any other text throws and catches an error,
#: which costs a hundred times the look.
_SPACE = r"[\x00-\x20\x7f]*"
_LOOKS = {
    "bigint": rf"^{_SPACE}[+-]?[0-9]+{_SPACE}$",
    "double": rf"(?i)^{_SPACE}[+-]?(nan|inf|infinity|0x[0-9a-f.]+p[+-]?[0-9]+[fd]?"
    rf"|([0-9]+(\.[0-9]*)?|\.[0-9]+)(e[+-]?[0-9]+)?[fd]?){_SPACE}$",
    "timestamp_ntz": rf"^{_SPACE}[+-]?[0-9]{{4,6}}({_SPACE}$|-[0-9]{{1,2}}({_SPACE}$|-[0-9]{{1,2}}([ T]|{_SPACE}$)))",
}


def type_counts(texts: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """column_name, non_null, and for each inferred type how many values do not have it; one scan, one row a column."""
    columns = texts.columns if columns is None else list(columns)

    def lacks(c: str, kind: T.DataType) -> Column:
        # A leading plus makes text of a number, as of a telephone number.
        value = F.trim(c)
        read = F.when(value.rlike(_LOOKS[kind.simpleString()]), value.try_cast(kind))
        return F.col(c).isNotNull() & (read.isNull() | value.startswith("+"))

    counts = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.count(c).alias("non_null"),
            *[
                F.count_if(lacks(c, kind)).alias(f"not_{kind.typeName()}")
                for kind in INFERRED
            ],
        )
        for c in columns
    ]
    return texts.agg(F.array(*counts).alias("c")).select(F.inline("c"))


def inferred_types(texts: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """column_name, data_type, non_null: the narrowest type that every value of a text column has. A column
    without values stays text."""
    counts = type_counts(texts, columns)
    kind = F.when(F.col("non_null") == 0, "string")
    for t in INFERRED:
        kind = kind.when(F.col(f"not_{t.typeName()}") == 0, t.simpleString())
    return counts.select("column_name", kind.otherwise("string").alias("data_type"), "non_null").orderBy("column_name")


def infer_types(
    texts: DataFrame, names: Mapping[str, str], overrides: Mapping[str, T.DataType] | None = None
) -> dict[str, T.DataType]:
    """Types by canonical name for `csv_schema`: inferred in one scan of text columns, overrides and the fixed types
    of times and amounts winning. Columns that have a type already are not looked at."""
    fixed = {**_TYPES, **(overrides or {})}
    open_ = [c for c in texts.columns if names.get(c, c) not in fixed]
    known = {t.simpleString(): t for t in INFERRED}
    found = inferred_types(texts, open_).collect() if open_ else []  # a row per column
    return fixed | {names.get(r["column_name"], r["column_name"]): known[r["data_type"]] for r in found if r["data_type"] in known}


def _canonical(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed({header: names[header] for header in df.columns if header in names})


def _load_csv(spark, path, names, headers, overrides, infer) -> DataFrame:
    if headers is None:
        # Only the header line is looked at; types come from the explicit schema.
        headers = spark.read.csv(path, header=True).columns
    if infer:
        texts = T.StructType([T.StructField(h, T.StringType()) for h in headers])
        overrides = infer_types(spark.read.schema(texts).csv(path, header=True), names, overrides)
    reader = spark.read.schema(csv_schema(headers, names, overrides))
    # A bad number or timestamp stops the load instead of turning into NULL.
    return _canonical(reader.csv(path, header=True, mode="FAILFAST", enforceSchema=False), names)


def load_transactions(
    spark: SparkSession,
    path: str,
    *,
    headers: Iterable[str] | None = None,
    types: Mapping[str, T.DataType] | None = None,
    infer: bool = False,
) -> DataFrame:
    """The file's rows under canonical names. With `infer`, columns without a given or fixed type get the narrowest
    one that all their values have, at the price of one more scan; else they are text."""
    return _load_csv(spark, path, fv.TRANSACTION_HEADERS, headers, types, infer)


def load_customers(
    spark: SparkSession,
    path: str,
    *,
    headers: Iterable[str] | None = None,
    types: Mapping[str, T.DataType] | None = None,
    infer: bool = False,
) -> DataFrame:
    """The file's rows under canonical names. With `infer`, columns without a given or fixed type get the narrowest
    one that all their values have, at the price of one more scan; else they are text."""
    return _load_csv(spark, path, fv.CUSTOMER_HEADERS, headers, types, infer)


def parse_csv_lines(
    lines: DataFrame,
    line: str,
    headers: Iterable[str],
    names: Mapping[str, str],
    types: Mapping[str, T.DataType] | None = None,
    options: Mapping[str, str] | None = None,
) -> DataFrame:
    """Rows of CSV text, one per line, typed as the loaders type a file; a bad value stops the job."""
    fields = csv_schema(headers, names, types).fields
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    parsed = F.from_csv(F.col(line), schema, {"mode": "FAILFAST", **(options or {})})
    return _canonical(lines.select(parsed.alias("row")).select("row.*"), names)


def clean(df: DataFrame, columns: Iterable[str] = fv.CLEANED_COLUMNS, unknown: str = fv.UNKNOWN) -> DataFrame:
    """Blank or missing categories become one explicit category."""
    present = [c for c in columns if c in df.columns]
    tidy = {c: F.when(F.trim(c) == "", None).otherwise(F.col(c)) for c in present}
    return df.withColumns({c: F.coalesce(value, F.lit(unknown)) for c, value in tidy.items()}) if present else df


def preview(df: DataFrame, key: str, rows: int = fv.PREVIEW_ROWS) -> DataFrame:
    return df.orderBy(key).limit(rows)


def derived_columns(ledger: DataFrame) -> DataFrame:
    """Month label and 0/1 success and review columns."""
    return ledger.withColumns(
        {
            "month": month_label(F.col("txn_ts")),
            "is_success": F.coalesce(successful(), F.lit(False)).cast("int"),
            "is_flag": F.coalesce(flagged(), F.lit(False)).cast("int"),
        }
    )


def save_by_month(ledger: DataFrame, path: str) -> None:
    """Store as parquet partitioned by month, so month filters prune whole directories.

    Rebalancing on the partition column lets adaptive execution split a large month over
    several writers and merge small ones, one file set per month. Months that the ledger
    does not hold stay as they are stored.
    """
    monthly = ledger.withColumn("month", month_label(F.col("txn_ts")))
    writer = monthly.hint("rebalance", "month").write.mode("overwrite")
    writer.option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)


def save_table(df: DataFrame, name: str, buckets: int, *, key: str = "customer_id", path: str | None = None) -> None:
    """Store a query's result as a table bucketed and sorted by `key`, replacing one of that name.

    Tables of the same number of buckets join and group by the key without a shuffle. Rows are dealt to buckets before
    they are written, so there is one file a bucket.
    """
    writer = df.repartition(buckets, key).write.mode("overwrite").format("parquet").bucketBy(buckets, key).sortBy(key)
    (writer.option("path", path) if path else writer).saveAsTable(name)


def register_views(ledger: DataFrame, accounts: DataFrame) -> None:
    """Expose both tables to `spark.sql` as `transactions` and `customers`, and the quartile model as `customer_rfm`."""
    ledger.createOrReplaceTempView("transactions")
    accounts.createOrReplaceTempView("customers")
    rfm.customer_rfm(ledger).createOrReplaceTempView("customer_rfm")
