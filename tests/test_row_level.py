"""Typed loading, stored tables, mergeable customer states and row-level reconciliation."""

import random
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens import fixed_values as fv
from ledgerlens import reports
from ledgerlens.operators import customers, kpi, rfm
from ledgerlens.sources import ledger as tables
from ledgerlens.sources import testbed

SF_DIR = "/root/testdata/sf0.01"

WIDE = """i,d,t,s,neg,empty,mixed,exp,big,when
1,1.5,2026-01-01 10:00:00,a,-3,,1,1e3,9223372036854775807,2026-01-01
2,2,2026-01-02 11:30:00.5,b,+4,,x,2.5E-2,-9223372036854775808,2026-02-03
 3 ,,,c,0,,2.5,7,12,
"""


def test_types_of_a_wide_file_are_those_of_duckdb(spark, tmp_path):
    import duckdb

    path = tmp_path / "wide.csv"
    path.write_text(WIDE)
    texts = spark.read.csv(str(path), header=True)
    got = {r.column_name: r.data_type for r in tables.inferred_types(texts).collect()}
    assert got["empty"] == "string" and got.pop("empty")
    listed = duckdb.sql(f"describe select * from read_csv('{path}')").fetchall()
    same = {"BIGINT": "bigint", "DOUBLE": "double", "TIMESTAMP": "timestamp_ntz", "DATE": "timestamp_ntz", "VARCHAR": "string"}
    assert got == {name: same[kind] for name, kind, *_ in listed if name != "empty"}


def test_loader_infers_and_overrides_win(spark, tmp_path):
    headers = list(fv.TRANSACTION_HEADERS)
    by_name = {fv.TRANSACTION_HEADERS[h]: h for h in headers}
    row = {"txn_id": "7", "customer_id": "42", "txn_ts": "2026-01-01 10:00:00", "amount": "12.50", "status": "Successful"}
    line = ",".join(row.get(fv.TRANSACTION_HEADERS[h], "x") for h in headers)
    path = tmp_path / "t.csv"
    path.write_text(",".join(headers) + "\n" + line + "\n")
    kinds = dict(tables.load_transactions(spark, str(path), infer=True).dtypes)
    assert kinds["txn_id"] == kinds["customer_id"] == "bigint" and kinds["status"] == "string"
    assert kinds["amount"] == "decimal(18,2)" and kinds["txn_ts"] == "timestamp_ntz"
    given = tables.load_transactions(spark, str(path), infer=True, types={"customer_id": T.StringType()})
    assert dict(given.dtypes)["customer_id"] == "string" and given.first().customer_id == "42"
    assert dict(tables.load_transactions(spark, str(path)).dtypes)["txn_id"] == "string"
    assert by_name["txn_id"] in headers


def test_types_are_found_in_one_scan(spark):
    df = testbed.event_ledger(spark, SF_DIR)
    plan = tables.inferred_types(df.select(*[F.col(c).cast("string").alias(c) for c in df.columns]))
    assert plan._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1


@pytest.fixture(scope="module")
def bucketed(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tables")
    tables.save_table(testbed.event_ledger(spark, SF_DIR), "stored_ledger", 4, path=str(root / "ledger"))
    tables.save_table(testbed.accounts(spark, SF_DIR), "stored_accounts", 4, path=str(root / "accounts"))
    yield spark.table("stored_ledger"), spark.table("stored_accounts")
    spark.sql("drop table stored_ledger")
    spark.sql("drop table stored_accounts")


@pytest.mark.parametrize(
    "name", ["segment_behaviour", "account_status_activity", "preferred_channel_match", "account_status_exposure", "customer_model"]
)
def test_stored_tables_join_without_a_shuffle(spark, bucketed, name):
    ledger, accounts = bucketed
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = reports.run(name, ledger, accounts)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan[plan.index("Join") :]
        want = reports.run(name, testbed.event_ledger(spark, SF_DIR), testbed.accounts(spark, SF_DIR))
        assert sorted(map(str, df.collect())) == sorted(map(str, want.collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_saving_a_table_again_replaces_it(spark, tmp_path):
    df = spark.range(10).withColumnRenamed("id", "customer_id")
    for n in (10, 3):
        tables.save_table(df.filter(F.col("customer_id") < n), "stored_again", 2, path=str(tmp_path / "t"))
    assert spark.table("stored_again").count() == 3
    spark.sql("drop table stored_again")


@pytest.mark.parametrize("ledger", [testbed.event_ledger, testbed.gapped_ledger, testbed.order_ledger])
def test_merged_states_equal_the_recomputed_model(spark, ledger, tmp_path):
    rows, accounts = ledger(spark, SF_DIR), testbed.accounts(spark, SF_DIR)
    states = customers.monthly_state(rows)
    months = sorted(r.month for r in states.select("month").distinct().collect() if r.month is not None)
    columns = [c for c in states.columns if c != "month"]
    state = customers.merge_states(states.filter(F.col("month").isNull()).select(*columns))
    for month in months[:4]:  # months arrive one by one
        state = customers.merge_states(state.select(*columns).union(states.filter(F.col("month") == month).select(*columns)))
    later = states.filter(F.col("month") > months[min(3, len(months) - 1)])
    state = customers.merge_states(state.select(*columns).union(later.select(*columns)))
    state.write.parquet(str(tmp_path / "state"))
    state = spark.read.parquet(str(tmp_path / "state"))
    text = lambda df: sorted(re.sub(r"\.0+\b", "", str(r)) for r in df.collect())
    assert text(customers.customer_model_of(state, accounts)) == text(customers.customer_model(rows, accounts))
    assert text(rfm.customer_rfm_of(state)) == text(rfm.customer_rfm(rows))


def rows_of(n, seed=1):
    rng = random.Random(seed)
    return [(i, rng.choice([None, "a", "b"]), rng.choice([None, float(i)])) for i in range(n)]


SCHEMA = "k bigint, s string, v double"


def found(spark, left, right, **kw):
    frames = [spark.createDataFrame(rows, SCHEMA).repartition(3) for rows in (left, right)]
    return sorted(map(tuple, kpi.reconcile_rows(*frames, "k", **kw).collect()), key=str)


@pytest.mark.parametrize("ranges", [1, 4, 64])
def test_rows_that_differ(spark, ranges):
    rows = rows_of(500)
    assert found(spark, rows, rows[::-1], ranges=ranges) == []
    changed = {100: (100, "other", rows[100][2]), 200: (200, "z", -1.0)}
    right = [changed.get(r[0], r) for r in rows if r[0] != 77] + [(900, None, None), (3, "again", 0.0)]
    wanted = [
        (100, "changed", 1, 1, "s"),
        (200, "changed", 1, 1, "s,v"),
        (3, "only_right", 0, 1, None),
        (77, "only_left", 1, 0, None),
        (900, "only_right", 0, 1, None),
    ]
    assert found(spark, rows, right, ranges=ranges) == sorted(wanted, key=str)


def test_missing_keys_repeated_rows_and_empty_sides(spark):
    left = [(None, "a", 1.0)] * 3 + [(1, "x", None)] * 5
    right = [(None, "a", 1.0)] * 2 + [(None, None, 1.0)] + [(1, "x", None)] * 7
    assert found(spark, left, right) == [(1, "only_right", 0, 2, None), (None, "changed", 1, 1, "s")]
    assert found(spark, left, left[::-1]) == [] and found(spark, [], []) == []
    assert found(spark, [], [(1, None, None)]) == [(1, "only_right", 0, 1, None)]
    with pytest.raises(ValueError, match="columns"):
        kpi.reconcile_rows(spark.range(1), spark.range(1).withColumnRenamed("id", "k"), "id")


def test_text_keys(spark):
    left = spark.createDataFrame([(f"T{i:05d}", i) for i in range(300)], "k string, v int")
    right = left.withColumn("v", F.when(F.col("k") == "T00123", -1).otherwise(F.col("v")))
    assert [tuple(r) for r in kpi.reconcile_rows(left, right, "k", ranges=16).collect()] == [("T00123", "changed", 1, 1, "v")]


def test_one_changed_row_is_found_by_reading_one_range(spark, tmp_path):
    left = spark.range(0, 200_000, numPartitions=8).selectExpr("id as k", "cast(id % 97 as string) as s", "cast(id as double) as v")
    right = left.withColumn("v", F.when(F.col("k") == 123_456, -1.0).otherwise(F.col("v")))
    sides = []
    for df, name in ((left, "l"), (right, "r")):
        df.write.option("parquet.block.size", 64 << 10).option("maxRecordsPerFile", 2_000).parquet(str(tmp_path / name))
        sides.append(spark.read.parquet(str(tmp_path / name)))
    splits = kpi.range_splits(sides[0], "k", 100)
    numbers = kpi.differing_ranges(*sides, "k", splits)
    assert len(numbers) == 1 and 50 <= len(splits) <= 200
    for side in sides:
        near = kpi.in_ranges(side, "k", splits, numbers)
        assert near.count() < 8_000
        plan = near._jdf.queryExecution().executedPlan().toString()
        assert "PushedFilters: [IsNotNull(k), GreaterThanOrEqual(k," in plan
    (row,) = kpi.reconcile_rows(*sides, "k", 100).collect()
    assert tuple(row) == (123_456, "changed", 1, 1, "v")
