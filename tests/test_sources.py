import datetime as dt
import decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.sources import ledger as tables

TRANSACTIONS = """Transaction_ID,Customer_ID,Transaction_DateTime,Transaction_Type,Channel,Amount_NGN,Transaction_Status,International_Transaction,Risk_Review_Flag,Device_Type,Location
T1,C1,2026-01-31 23:59:59,Transfer,Web,1500.25,Successful,Yes,No,,Lagos
T2,C2,2026-02-01 00:00:00,Deposit,ATM,20,Failed,No,Yes,  ,
"""
CUSTOMERS = """Customer_ID,Customer_Segment,Account_Status,Preferred_Channel
C1,SME,Active,Web
"""


@pytest.fixture()
def csv_dir(tmp_path):
    (tmp_path / "transactions.csv").write_text(TRANSACTIONS)
    (tmp_path / "customers.csv").write_text(CUSTOMERS)
    return tmp_path


def test_load_transactions(spark, csv_dir):
    df = tables.load_transactions(spark, str(csv_dir / "transactions.csv"))
    types = dict(df.dtypes)
    assert types["international"] == types["risk_flag"] == types["txn_id"] == "string"
    assert (types["txn_ts"], types["amount"]) == ("timestamp_ntz", "decimal(18,2)")
    first = df.orderBy("txn_id").first()
    assert (first.txn_ts, first.amount, first.international) == (
        dt.datetime(2026, 1, 31, 23, 59, 59),
        decimal.Decimal("1500.25"),
        "Yes",
    )


def test_load_with_given_headers_and_types(spark, csv_dir):
    df = tables.load_transactions(
        spark,
        str(csv_dir / "transactions.csv"),
        headers=TRANSACTIONS.splitlines()[0].split(","),
        types={"amount": T.DoubleType()},
    )
    assert dict(df.dtypes)["amount"] == "double" and df.count() == 2


def test_bad_value_stops_the_load(spark, tmp_path):
    (tmp_path / "bad.csv").write_text(TRANSACTIONS.replace("1500.25", "lots"))
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        tables.load_transactions(spark, str(tmp_path / "bad.csv")).collect()


def test_load_customers(spark, csv_dir):
    df = tables.load_customers(spark, str(csv_dir / "customers.csv"))
    assert df.columns == ["customer_id", "segment", "account_status", "preferred_channel"]
    assert df.first().segment == "SME"


def test_clean(spark, csv_dir):
    df = tables.clean(tables.load_transactions(spark, str(csv_dir / "transactions.csv")))
    assert [(r.device_type, r.location) for r in df.orderBy("txn_id").collect()] == [
        ("Unknown", "Lagos"),
        ("Unknown", "Unknown"),
    ]


def test_clean_without_those_columns_changes_nothing(accounts_of):
    accounts = accounts_of((1, "", "Active", "Web"))
    assert tables.clean(accounts).collect() == accounts.collect()


def test_derived_columns(ledger_of):
    got = tables.derived_columns(ledger_of({"status": None, "risk_flag": "Yes"})).first()
    assert (got.month, got.is_success, got.is_flag) == ("2026-01", 0, 1)


def test_save_by_month_prunes(spark, tmp_path, ledger_of):
    ledger = ledger_of({"txn_ts": dt.datetime(2026, 1, 31)}, {"txn_ts": dt.datetime(2026, 2, 1)})
    path = str(tmp_path / "ledger")
    tables.save_by_month(ledger, path)
    stored = spark.read.parquet(path)
    february = stored.filter("month = '2026-02'")
    assert february.count() == 1
    plan = february._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan


def test_register_views(spark, ledger_of, accounts_of):
    tables.register_views(ledger_of({}, {}), accounts_of((1, "SME", "Active", "Web")))
    assert spark.sql("select count(*) from transactions join customers using (customer_id)").first()[0] == 2


def test_storing_one_month_leaves_the_others(spark, tmp_path, ledger_of):
    path = str(tmp_path / "ledger")
    tables.save_by_month(ledger_of({"txn_ts": dt.datetime(2026, 1, 5)}, {"txn_ts": dt.datetime(2026, 2, 5)}), path)
    tables.save_by_month(ledger_of({"txn_ts": dt.datetime(2026, 2, 6), "amount": 7.0}), path)
    stored = spark.read.parquet(path).orderBy("txn_ts").collect()
    assert [(r.txn_ts.month, r.amount) for r in stored] == [(1, 100.0), (2, 7.0)]


def test_quartile_model_is_a_view(spark, ledger_of, accounts_of):
    tables.register_views(ledger_of({}), accounts_of((1, "SME", "Active", "Web")))
    assert spark.sql("select rfm_segment, count(*) as n from customer_rfm group by 1").first().n == 1


ODD_TEXTS = (
    "", "1", "-1", "+1", "1.5", "1.", ".", ".5", "1e5", "1E-5", "1d", "1.5F", "nan", "NaN", "inf", "-Infinity", "0x1p3", "0X1.8P-2", "0x1",
    "1_000", "1,000", "2024", "20245", "2024567", "2024-1", "2024-01-", "2024-1-5", "2024-01-05 10:20", "2024-01-05T10:20:30.123456",
    "2024-01-05T10:20:30Z", "2024-01-05\t", "2024-01-05x", "2024-13-45", "12:30", "T12:30", "-2024-01-01", "+20240-01-01", "\x7f2024-01-05",
    "9223372036854775808", "1e400", "abc", "1 2", "\u0661\u0662", " 1 ", "\t1.5\t", "1\n", "\x001", "1\x7f", "1\u0085", "--1", "e5", "Nation 7",
)


def test_only_texts_that_look_like_a_type_are_cast_to_it(spark):
    texts = spark.createDataFrame([(t,) for t in ODD_TEXTS], "t string")
    row = tables.type_counts(texts).first()
    for kind in tables.INFERRED:
        read = F.trim("t").try_cast(kind).isNotNull() & ~F.trim("t").startswith("+")
        assert row[f"not_{kind.typeName()}"] == texts.filter(~read).count()
    plan = tables.type_counts(texts)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE") == len(tables.INFERRED)  # a cast that fails throws inside, which took most of the time
