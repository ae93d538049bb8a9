"""The distributed plans against plain windows and against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerlens.plans import bins, ordering


def skewed_values(n, seed=1):
    """A third of all rows share one value."""
    rng = random.Random(seed)
    return [500.0 if i % 3 == 0 else float(rng.randrange(1, 900)) for i in range(n)]


@pytest.fixture(scope="module")
def skewed(spark):
    rows = [(i, v, "hot" if i % 3 == 0 else f"g{i % 4}") for i, v in enumerate(skewed_values(3000))]
    return spark.createDataFrame(rows, "id bigint, v double, g string").repartition(5).cache()


def ntile(n, k):
    size, spare = divmod(n, k)
    out = []
    for tile in range(1, k + 1):
        out += [tile] * (size + (tile <= spare))
    return out


@pytest.mark.parametrize("n", [0, 1, 3, 10, 25, 101, 3000])
def test_ntile(spark, skewed, n):
    df = skewed.filter(F.col("id") < n)
    tiles = ordering.with_tiles(df, {"t": -F.col("v")}, "id", ordering.ntile_ranks(10))
    got = {r.id: r.t for r in tiles.collect()}
    ranked = sorted(enumerate(skewed_values(3000)[:n]), key=lambda r: (-r[1], r[0]))
    assert got == {i: t for (i, _), t in zip(ranked, ntile(n, 10))}


@pytest.mark.parametrize("n", [1, 7, 25, 150, 1507])
def test_quantile_ranks_equal_edges_over_ranks(skewed, n):
    df = skewed.filter(F.col("id") < n)
    tiles = ordering.with_tiles(df, {"t": F.col("v")}, "id", ordering.quantile_ranks(10))
    got = [r.t for r in tiles.orderBy("v", "id").collect()]
    ranks = np.arange(1, n + 1)
    edges = np.quantile(ranks, np.arange(1, 10) / 10)
    assert got == [1 + int((rank > edges).sum()) for rank in ranks]


def test_quantile_sizes_differ_from_ntile(skewed):
    df = skewed.filter(F.col("id") < 25)
    tiles = ordering.with_tiles(df, {"t": F.col("v")}, "id", ordering.quantile_ranks(10))
    sizes = [r["count"] for r in tiles.groupBy("t").count().orderBy("t").collect()]
    assert sizes == [3, 2, 3, 2, 3, 2, 2, 3, 2, 3]


def test_fraction_ranks_below_one_row(skewed):
    df = skewed.filter(F.col("id") < 5)
    tiles = ordering.with_tiles(df, {"t": F.col("v")}, "id", ordering.fraction_ranks(0.1, 0.5))
    # Nothing fits into the first tenth of five rows; two fit into the first half.
    assert [r.t for r in tiles.orderBy("v", "id").collect()] == [2, 2, 3, 3, 3]


def test_several_tiles_in_one_pass(skewed):
    orders = {"up": F.col("v"), "down": -F.col("v"), "by_id": F.col("id").cast("double")}
    plain = skewed.withColumns({name: F.ntile(4).over(Window.orderBy(by, "id")) for name, by in orders.items()})
    tiles = ordering.with_tiles(skewed, orders, "id", ordering.ntile_ranks(4))
    assert sorted(plain.collect()) == sorted(tiles.collect())


def test_missing_values_come_last_in_both_directions(spark):
    rows = [(i, None if i % 4 == 0 else float(i % 5)) for i in range(40)] + [(None, 2.0)]
    df = spark.createDataFrame(rows, "id bigint, v double").repartition(3)
    for by in (F.col("v"), -F.col("v")):
        order = Window.orderBy(by.isNull(), by, F.col("id").isNull(), "id")
        plain = df.withColumn("t", F.ntile(7).over(order))
        tiles = ordering.with_tiles(df, {"t": by}, "id", ordering.ntile_ranks(7))
        assert sorted(plain.collect(), key=str) == sorted(tiles.collect(), key=str)


@pytest.mark.parametrize("copies", [1, 3, 10])
@pytest.mark.parametrize("n", [1, 9, 10, 64])
def test_counted_tiles_divide_repeated_rows_by_number(spark, n, copies):
    rng = random.Random(n * copies)
    rows = [(i, rng.choice([None, 1.0, 2.0, 3.0, 50.0])) for i in range(n)] * copies
    df = spark.createDataFrame(rows, "id bigint, v double").repartition(4)
    got = bins.counted_tiles(df, "v", "id", {"odd": F.col("id") % 2}, ordering.ntile_ranks(4))
    got = {r.tile: (r.n, r.total, r.odd) for r in got.groupBy("tile").agg(F.sum("rows").alias("n"), F.sum("total").alias("total"), F.sum("odd").alias("odd")).collect()}
    ranked = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    wanted = {}
    for (i, v), tile in zip(ranked, ntile(len(rows), 4)):
        m, total, odd = wanted.get(tile, (0, None, 0))
        wanted[tile] = (m + 1, total if v is None else (total or 0) + v, odd + i % 2)
    assert got == wanted


def test_unique_rows_make_a_tiebreak(spark):
    df = spark.createDataFrame([(1, 5.0)] * 6 + [(None, 5.0)] * 3 + [(2, 7.0)], "id bigint, v double")
    numbered, copy = ordering.unique_rows(df, "id")
    tiles = ordering.with_tiles(numbered, {"t": F.col("v")}, copy, ordering.ntile_ranks(5))
    assert sorted(r.t for r in tiles.collect()) == ntile(10, 5)


def test_text_tiebreak(spark):
    rows = [(f"C{i:04d}", 7.0) for i in range(97)]
    df = spark.createDataFrame(rows, "id string, v double").repartition(3)
    tiles = ordering.with_tiles(df, {"t": F.col("v")}, "id", ordering.ntile_ranks(5))
    assert [r.t for r in tiles.orderBy("id").collect()] == ntile(97, 5)


def test_running_totals(skewed):
    items = skewed.withColumn("one", F.lit(1).cast("bigint"))
    out = ordering.running_totals(items, ["v", "id"], ["one", "v"]).collect()
    ranked = sorted(enumerate(skewed_values(3000)), key=lambda r: (r[1], r[0]))
    total, expected = 0.0, {}
    for rank, (i, v) in enumerate(ranked, start=1):
        total += v
        expected[i] = (rank, total, 3000, sum(skewed_values(3000)))
    assert {r.id: (r.one_to, r.v_to, r.one_all, r.v_all) for r in out} == expected


def test_running_totals_keep_a_missing_group(spark):
    rows = [("a", 1, 10), (None, 1, 5), (None, 2, 7), ("a", 2, 1)]
    items = spark.createDataFrame(rows, "g string, k int, m bigint")
    out = ordering.running_totals(items, ["k"], ["m"], ["g"])
    assert {(r.g, r.k): (r.m_to, r.m_all) for r in out.collect()} == {
        ("a", 1): (10, 11),
        ("a", 2): (11, 11),
        (None, 1): (5, 12),
        (None, 2): (12, 12),
    }


def test_percentiles_per_group(skewed):
    qs = (0.0, 0.2, 0.25, 0.5, 0.75, 0.9, 1.0)
    counted = ordering.value_counts(skewed, "v", ["g"])
    got = {r.g: list(r.q) for r in counted.groupBy("g").agg(F.array(*[ordering.percentile(q) for q in qs]).alias("q")).collect()}
    by_group = {}
    for r in skewed.collect():
        by_group.setdefault(r.g, []).append(r.v)
    assert got.keys() == by_group.keys()
    for g, values in by_group.items():
        assert got[g] == pytest.approx(list(np.quantile(values, qs)))


def test_refined_percentiles_are_exact(spark, skewed):
    rng = random.Random(9)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, -3.5, 0.0, rng.uniform(-1e6, 1e6), rng.expovariate(1e-3)])) for _ in range(900)]
    df = spark.createDataFrame(rows + [("one", 7.0), ("none", None)], "g string, v double").repartition(4)
    qs = {"q0": 0.0, "q1": 0.1, "q2": 0.25, "q5": 0.5, "q9": 0.93, "q10": 1.0}
    got = {r.g: [r[q] for q in qs] for r in bins.exact_percentiles(df, "v", qs, ["g"]).collect()}
    groups = {}
    for g, v in [*rows, ("one", 7.0)]:
        if v is not None:
            groups.setdefault(g, []).append(v)
    assert got.keys() == groups.keys()
    for g, values in groups.items():
        assert got[g] == pytest.approx(list(np.quantile(values, list(qs.values()))))
    assert bins.exact_percentiles(df.limit(0), "v", qs, ["g"]).count() == 0
    assert list(bins.exact_percentiles(df.limit(0), "v", qs).first()) == [None] * len(qs)


def test_slices_are_even_despite_ties(skewed):
    """No slice holds much more than its share although a third of the rows tie."""
    buckets = ordering.bucket_count(skewed.sparkSession)
    sizes = ordering._with_bucket(skewed.select("v", "id"), ["v", "id"]).groupBy("_bucket").count().collect()
    assert len(sizes) >= buckets
    assert max(r["count"] for r in sizes) <= 4 * 3000 / buckets


def test_the_bucket_search_stays_small_when_the_optimizer_follows_it(spark):
    df = spark.range(40).withColumn("v", F.col("id") % 7)
    size, before = {}, spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for partitions in (4, 32):
            spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
            found = ordering._with_bucket(df, ["v", "id"]).filter("_bucket >= 1")
            size[partitions] = len(found._jdf.queryExecution().optimizedPlan().toString())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    # A name for each step, replaced by its definition, would triple the condition with every doubling of the slices.
    assert size[32] < 1.3 * size[4]
