"""Bins, moments and fences against numpy and against plain windows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens import fixed_values as fv
from ledgerlens import reports
from ledgerlens.operators import profiling, sequence, statistics
from ledgerlens.plans import bins
from ledgerlens.sources import ledger as tables
from ledgerlens.sources import testbed

SF_DIR = "/root/testdata/sf0.01"


def values(seed, n=600):
    rng = random.Random(seed)
    kinds = [lambda: rng.uniform(-1e6, 1e6), lambda: rng.expovariate(1e-3), lambda: float(rng.randrange(9)), lambda: 7.5, lambda: None]
    return [(rng.choice(["a", "b", None]), rng.choice(kinds)()) for _ in range(n)]


@pytest.fixture(scope="module")
def mixed(spark):
    rows = values(1) + [("one", 7.0), ("none", None)]
    return rows, spark.createDataFrame(rows, "g string, v double").repartition(4)


def grouped(rows):
    out = {}
    for g, v in rows:
        out.setdefault(g, [])
        if v is not None:
            out[g].append(v)
    return out


def test_moments_totals_and_extremes(mixed):
    rows, df = mixed
    found = bins.items(df, "v", [0.5], ["g"], {"n": F.count(F.lit(1)), "total": F.sum("v")})
    found = found.groupBy("g").agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("mean").alias("mean"), F.sum("m2").alias("m2"),
        F.sum("m3").alias("m3"), F.min("least").alias("least"), F.max("most").alias("most"),
        bins.percentile(0.5).alias("median"), bins.counted_rows(F.col("least") > F.col("mean")).alias("_"),
    )
    got = {r.g: r for r in found.collect()}
    by = grouped(rows)
    assert got.keys() == by.keys()
    for g, vs in by.items():
        r, x = got[g], np.array(vs)
        assert r.n == sum(1 for h, _ in rows if h == g)
        if not vs:
            assert r.total is None and r.median is None and r.least is None
            continue
        assert r.total == pytest.approx(x.sum()) and r["mean"] == pytest.approx(x.mean()) and r.median == pytest.approx(np.median(x))
        assert r.m2 == pytest.approx(((x - x.mean()) ** 2).sum(), rel=1e-9, abs=1e-9)
        assert r.m3 == pytest.approx(((x - x.mean()) ** 3).sum(), rel=1e-6, abs=1e-6)
        assert (r.least, r.most) == (x.min(), x.max())


def test_moments_keep_their_digits_far_from_zero(spark):
    x = [1.7e12 + i * 0.25 for i in range(200)]
    found = bins.items(spark.createDataFrame([(v,) for v in x], "v double"), "v", [0.5])
    # Plain sums of squares would lose everything: the values differ in their last bits only.
    assert found.agg(F.sum("m2")).first()[0] == pytest.approx(((np.array(x) - np.mean(x)) ** 2).sum(), rel=1e-6)


@pytest.mark.parametrize("seed", range(4))
def test_whiskers_and_outliers_equal_numpy(spark, seed):
    rng = random.Random(seed)
    shape = [lambda: rng.lognormvariate(5, 1.2), lambda: rng.gauss(0, 5), lambda: float(rng.randrange(40)), lambda: rng.choice([1.0, 1.0, 9.0])][seed]
    rows = [(rng.choice("xyz"), shape()) for _ in range(500)] + [("lone", 3.0), (None, 4.0), ("x", None)]
    df = spark.createDataFrame(rows, "txn_type string, amount double").repartition(3)
    got = {r.txn_type: r for r in statistics.box_stats(df).collect()}
    by = {g: np.array(v) for g, v in grouped(rows).items() if g is not None}
    assert got.keys() == by.keys()
    for g, x in by.items():
        q1, q2, q3 = np.quantile(x, [0.25, 0.5, 0.75])
        low, high = x[x >= q1 - 1.5 * (q3 - q1)].min(), x[x <= q3 + 1.5 * (q3 - q1)].max()
        r = got[g]
        assert (r.q1, r.median, r.q3, r.whisker_low, r.whisker_high) == pytest.approx((q1, q2, q3, low, high), abs=1e-4)
    x = np.array([v for _, v in rows if v is not None])
    q1, q3 = np.quantile(x, [0.25, 0.75])
    r = statistics.amount_outliers(df).first()
    assert r.outliers == int((x > q3 + 1.5 * (q3 - q1)).sum()) and r.maximum == pytest.approx(x.max(), abs=0.01)


def test_distinct_values_are_counted_by_the_same_scan(spark, mixed):
    rows, df = mixed
    keyed = df.withColumn("c", F.when(F.col("v") > 0, F.floor(F.col("v"))))
    found = bins.items(keyed, "v", [0.5], totals={"n": F.count(F.lit(1))}, distinct="c")
    got = found.agg(F.sum("n").alias("n"), F.max("distinct_values").alias("d"), bins.percentile(0.5).alias("m")).first()
    present = [v for _, v in rows if v is not None]
    assert got.n == len(rows) and got.d == len({int(v) for v in present if v > 0}) and got.m == pytest.approx(np.median(present))


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("bins") / "ledger")
    tables.save_by_month(testbed.event_ledger(spark, SF_DIR), path)
    return spark.read.parquet(path)


@pytest.mark.parametrize(
    ("name", "most"),
    [
        ("value_tiers", 2),
        ("kpi_summary", 2),
        ("type_value_skew", 2),
        ("profile_describe_transactions", 2),
        ("box_stats", 2),
        ("amount_outliers", 2),
        ("gap_since_previous", 1),
        ("customer_rfm", 1),
    ],
)
def test_scans_of_the_ledger(spark, stored, name, most):
    """Rows read by the whole query, from the scans' own counters, against the rows of the ledger."""
    df = reports.run(name, stored, testbed.accounts(spark, SF_DIR))
    df.collect()
    assert rows_scanned(spark, df) <= most * stored.count()


def rows_scanned(spark, df) -> int:
    """Sum of `number of output rows` over the file scans of a query that ran."""
    total, seen = 0, set()

    def walk(node):
        nonlocal total
        name = node.getClass().getSimpleName()
        if name in ("ReusedExchangeExec", "ReusedSubqueryExec"):
            return
        if name == "FileSourceScanExec":
            metric = node.metrics().apply("numOutputRows")
            if metric.id() not in seen:
                seen.add(metric.id())
                total += metric.value()
            return
        if name == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if name.endswith("QueryStageExec"):
            return walk(node.plan())
        for group in (node.children(), node.subqueries()):
            for i in range(group.size()):
                walk(group.apply(i))
        if name in ("SubqueryExec",):
            walk(node.child())

    walk(df._jdf.queryExecution().executedPlan())
    return total


@pytest.mark.parametrize("name", ["amount_outliers", "box_stats"])
def test_few_rows_of_a_column_of_different_values_are_shuffled(spark, name):
    rng = random.Random(5)
    rows = [(rng.choice("xy"), rng.lognormvariate(8, 1)) for _ in range(20_000)]
    df = spark.createDataFrame(rows, "txn_type string, amount double").repartition(4)
    near = bins.items(df, "amount", [0.25, 0.5, 0.75], ["txn_type"] if name == "box_stats" else (), fence_iqrs=fv.WHISKER_IQRS)
    shown = near.filter("m2 is null").count()  # the values looked at one by one
    assert 0 < shown < 0.09 * len(rows)


def hot_ledger(ledger_of):
    """A third of all rows in one customer's day, a third without a customer."""
    import datetime as dt

    rng, day, rows = random.Random(3), dt.datetime(2026, 3, 1), []
    for i in range(1_200):
        customer = [1, None, rng.randrange(2, 60)][i % 3]
        at = day + dt.timedelta(seconds=rng.randrange(86_400)) if i % 3 < 2 else day + dt.timedelta(minutes=rng.randrange(30_000))
        rows.append({"customer_id": customer, "txn_ts": None if i % 17 == 0 else at, "risk_flag": rng.choice(["Yes", "No", None])})
    return rows, ledger_of(*rows)


def test_gaps_of_a_hot_day_and_of_no_customer(spark, ledger_of):
    rows, ledger = hot_ledger(ledger_of)
    full = [(r["customer_id"], r["txn_ts"], i, r["risk_flag"] == "Yes") for i, r in enumerate(rows, 1)]
    full.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or 0, r[2]))
    wanted, last = {}, None
    for r in full:
        label = fv.FIRST_LABEL
        if last and last[0] == r[0] and r[1] is not None and last[1] is not None:
            gap = int(r[1].timestamp() // 60) - int(last[1].timestamp() // 60)
            label = next((name for cut, name in zip(fv.GAP_CUTS, fv.GAP_LABELS) if gap <= cut), fv.GAP_LABELS[-1])
        n, f = wanted.get(label, (0, 0))
        wanted[label], last = (n + 1, f + r[3]), r
    got = {r.gap_since_previous: r for r in sequence.gap_since_previous(ledger).collect()}
    assert {k: r.txn_count for k, r in got.items()} == {k: n for k, (n, _) in wanted.items()}
    for k, (n, f) in wanted.items():
        assert got[k].review_rate_pct == pytest.approx(100 * f / n, abs=0.006)
    per_day = sequence.customer_minutes(ledger).groupBy("customer_id", "day").count()
    assert per_day.agg(F.max("count")).first()[0] <= 1_440


def test_gaps_of_many_rows_in_one_minute(ledger_of):
    import datetime as dt

    at = dt.datetime(2026, 3, 1, 9, 30)
    ledger = ledger_of(*[{"txn_ts": at, "txn_id": 5}] * 300, {"txn_ts": at - dt.timedelta(days=1), "risk_flag": "Yes"})
    assert sequence.customer_minutes(ledger).count() == 2
    got = {r.gap_since_previous: (r.txn_count, r.review_rate_pct) for r in sequence.gap_since_previous(ledger).collect()}
    assert got == {fv.FIRST_LABEL: (1, 100.0), fv.GAP_LABELS[0]: (299, 0.0), fv.GAP_LABELS[1]: (1, 0.0)}


def test_duplicates_by_digest(spark):
    rows = [(i % 40, None if i % 3 else "x", float(i % 2)) for i in range(200)] + [(None, "x", 0.0), (0, None, None), (None, None, None)]
    schema = "a int, b string, c double"
    for data in (rows, rows * 2, [], [(None, None, None)] * 5, [(1, "", 0.0), (1, None, 0.0), (1, "", -0.0)]):
        df = spark.createDataFrame(data, schema).repartition(3)
        assert profiling.profile_duplicates(df).first()[0] == len(data) - len(set(data))


def test_duplicate_shuffle_does_not_depend_on_the_width_of_rows(spark):
    """Of different rows none but those whose mark another digest set are shuffled in full."""
    df = spark.range(20_000, numPartitions=4).selectExpr("id", "repeat(cast(id as string), 50) as wide")
    twice = df.union(df.filter("id < 10"))
    out = profiling.profile_duplicates(twice)
    assert out.first()[0] == 10
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "getbit" in plan and plan.count("xxhash64") >= 3
