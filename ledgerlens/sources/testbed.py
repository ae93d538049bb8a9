"""Ledger views over the parquet test tables (see FIXTURES.md).

Every column is derived row by row from the given tables, so work grows with them. The
schemas are given, so opening a table reads no file footers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
_CUSTOMER = "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
_ORDERS = (
    "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string"
)


_EVENT_LEDGER = (
    "event_id as txn_id",
    "user_id as customer_id",
    "ts + make_dt_interval(cast((event_id % 3) * 30 as int)) as txn_ts",
    "event_type as txn_type",
    """case when event_id % 50 < 21 then 'Mobile App' when event_id % 50 < 31 then 'POS'
            when event_id % 50 < 39 then 'Web' when event_id % 50 < 46 then 'ATM' else 'USSD' end as channel""",
    "round(value * 1000) as amount",
    """case when k < 90 then 'Successful' when k < 95 then 'Failed'
            when k < 98 then 'Reversed' else 'Pending' end as status""",
    "case when event_id % 25 = 7 then 'Yes' else 'No' end as international",
    "case when value >= 100 or (event_id * 7 + k) % 6 = 0 then 'Yes' else 'No' end as risk_flag",
)
_ACCOUNTS = (
    "c_custkey as customer_id",
    "c_mktsegment as segment",
    """case when c_custkey % 14 = 3 then 'Dormant' when c_custkey % 58 = 5 then 'Restricted'
            else 'Active' end as account_status""",
    """case when c_custkey % 50 < 31 then 'Mobile App' when c_custkey % 50 < 43 then 'Web'
            else 'USSD' end as preferred_channel""",
    """case when c_custkey % 9 = 0 then '' when c_custkey % 9 = 3 then '  '
            when c_custkey % 9 <> 6 then 'Phone' end as device_type""",
    "case when c_custkey % 11 = 0 then '' when c_custkey % 11 <> 5 then 'Nation ' || c_nationkey end as location",
)
_ORDER_LEDGER = (
    "o_orderkey as txn_id",
    "o_custkey as customer_id",
    "o_orderdate as txn_ts",
    "o_orderpriority as txn_type",
    "cast(o_totalprice as decimal(18, 2)) as amount",
    "case o_orderstatus when 'F' then 'Successful' when 'P' then 'Pending' else 'Failed' end as status",
    "case when o_custkey % 25 = 7 then 'Yes' else 'No' end as international",
    "case when o_totalprice >= 300000 then 'Yes' else 'No' end as risk_flag",
)


def _table(spark: SparkSession, sf_dir: str, name: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{sf_dir}/{name}.parquet")


def event_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` as a ledger of whole-number amounts over three months."""
    events = _table(spark, sf_dir, "events", _EVENTS)
    return events.selectExpr("*", "cast(regexp_extract(props, '([0-9]+)', 1) as int) as k").selectExpr(*_EVENT_LEDGER)


def gapped_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event ledger with missing amounts and times by a rule on its ids; some customers have no amount at all."""
    missing = "customer_id % 11 = 5 or txn_id % 7 = 3"
    return event_ledger(spark, sf_dir).selectExpr(
        "* except (amount, txn_ts)",
        f"case when {missing} then null else amount end as amount",
        "case when txn_id % 13 = 4 then null else txn_ts end as txn_ts",
    )


def changed_copy(ledger: DataFrame) -> DataFrame:
    """The ledger with some rows changed, lost or added, by a rule on its ids."""
    return ledger.filter("txn_id % 997 <> 11").selectExpr(
        "* except (amount, channel)",
        "case when txn_id % 499 = 5 then amount + 1 else amount end as amount",
        "case when txn_id % 499 = 5 and txn_id % 2 = 0 then null else channel end as channel",
        "explode(sequence(1, case when txn_id % 991 = 3 then 2 else 1 end)) as copy",
    ).select(*ledger.columns)


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`customer` as the account table; some device and location texts are blank or missing."""
    return _table(spark, sf_dir, "customer", _CUSTOMER).selectExpr(*_ACCOUNTS)


def order_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`orders` as a second ledger: cents in decimal, midnights only, many calendar months."""
    return _table(spark, sf_dir, "orders", _ORDERS).selectExpr(*_ORDER_LEDGER)
