"""Two separate recency / frequency / monetary models.

The quartile model scores customers with a successful transaction by equal-sized groups;
the quintile model scores every customer by value edges, so ties share a score. They
differ in population, recency and segment rules and are not interchangeable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens import fixed_values as fv
from ledgerlens.functions.exprs import pct, round_to, row_count, successful, whole_days_between
from ledgerlens.operators.rates import share_of_all
from ledgerlens.plans.ordering import every_column, ntile_ranks, percentile, value_counts, with_tiles


def customer_rfm(ledger: DataFrame) -> DataFrame:
    """Quartile scores 1..4 (4 best) with customer_id as tie-break, and the segment they give.

    The newest time counts every status, the scores successful transactions only; both come
    from one aggregation per customer.
    """
    paid = successful()
    per_customer = ledger.groupBy("customer_id").agg(
        F.max("txn_ts").alias("any_ts"),
        F.max(F.when(paid, F.col("txn_ts"))).alias("last_ts"),
        F.count_if(paid).alias("frequency"),
        F.sum(F.when(paid, F.col("amount"))).alias("monetary"),
    )
    return rfm_of_customers(every_column(per_customer))


def rfm_of_customers(per_customer: DataFrame) -> DataFrame:
    """The same from one row per customer: customer_id, any_ts, last_ts, frequency and monetary."""
    newest = per_customer.agg(F.to_date(F.max("any_ts"))).scalar()
    per_customer = per_customer.withColumn("newest", newest).filter(F.col("frequency") > 0)
    per_customer = per_customer.select(
        "customer_id",
        F.datediff("newest", F.to_date("last_ts")).cast("bigint").alias("recency_days"),
        "frequency",
        "monetary",
    )
    scored = with_tiles(
        per_customer,
        {
            "r_score": -F.col("recency_days").cast("double"),
            "f_score": F.col("frequency").cast("double"),
            "m_score": F.col("monetary").cast("double"),
        },
        "customer_id",
        ntile_ranks(4),
    )
    # Fixed rule: thresholds and their order are part of the agreed result.
    high = fv.HIGH_QUARTILE
    r, f, m = F.col("r_score"), F.col("f_score"), F.col("m_score")
    champions, at_risk, low, core = fv.QUARTILE_SEGMENTS
    segment = (
        F.when((r >= high) & (f >= high) & (m >= high), champions)
        .when((r < high) & (m >= high), at_risk)
        .when((f < high) & (m < high), low)
        .otherwise(core)
    )
    return scored.withColumn("rfm_segment", segment)


def rfm_segment_summary(rfm: DataFrame) -> DataFrame:
    """Size and value of each quartile segment."""
    per_segment = rfm.groupBy("rfm_segment").agg(
        row_count().alias("customers"),
        round_to(F.avg("frequency"), 1).alias("avg_txns"),
        round_to(F.avg("monetary"), 0).alias("avg_value"),
        F.sum("monetary").alias("value"),
    )
    return per_segment.select(
        "rfm_segment",
        "customers",
        share_of_all(F.col("customers"), 1).alias("pct_customers"),
        "avg_txns",
        "avg_value",
        share_of_all(F.col("value"), 1).alias("pct_of_value"),
    ).orderBy(F.desc("avg_value"), "rfm_segment")


def rfm_vs_labels(rfm: DataFrame, accounts: DataFrame, label: str = "segment") -> DataFrame:
    """Whether the existing labels line up with the behavioural segments."""
    champions, at_risk, low, _ = fv.QUARTILE_SEGMENTS

    def part(segment: str, name: str) -> Column:
        return pct(F.count_if(F.col("rfm_segment") == segment), row_count(), 1).alias(name)

    return (
        rfm.select("customer_id", "rfm_segment")
        .join(accounts.select("customer_id", label), "customer_id")
        .groupBy(label)
        .agg(
            part(champions, "pct_champions"),
            part(at_risk, "pct_at_risk_high_value"),
            part(low, "pct_low_engagement"),
            row_count().alias("customers"),
        )
        .orderBy(label)
    )


def customer_rfm_of(state: DataFrame) -> DataFrame:
    """`customer_rfm` from merged customer states instead of the ledger."""
    return rfm_of_customers(
        every_column(
            state.select(
                "customer_id",
                "any_ts",
                F.col("last_paid_ts").alias("last_ts"),
                F.col("success_count").alias("frequency"),
                F.col("value_success").alias("monetary"),
            )
        )
    )


_METRICS = ("recency_days", "txn_count", "value_success")
_FIFTHS = (0.2, 0.4, 0.6, 0.8)


def with_recency(model: DataFrame) -> DataFrame:
    """Whole days from each customer's last transaction to a day after the newest one."""
    as_of = every_column(model).agg(F.max("last_txn") + F.expr("INTERVAL '1' DAY")).scalar()
    return model.withColumn("recency_days", whole_days_between(F.col("last_txn"), as_of))


def rfm_quintiles(model: DataFrame, on_duplicate: str = "raise") -> DataFrame:
    """Scores 1..5 by quantile edges of recency (reversed), activity and value; ordered segment rules.

    When equal values make two edges coincide there are fewer than five classes. "raise"
    fails the job in that case; "keep" leaves the unreachable scores empty.
    """
    if on_duplicate not in ("raise", "keep"):
        raise ValueError("on_duplicate is 'raise' or 'keep'")
    model = with_recency(model)
    metrics = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("x")) for m in _METRICS]))
    long = every_column(model).select(metrics.alias("m")).select("m.metric", "m.x")
    edges = value_counts(long, "x", ["metric"]).groupBy("metric").agg(
        F.array(*[percentile(q) for q in (0.0, *_FIFTHS, 1.0)]).alias("edges")
    )
    if on_duplicate == "raise":
        distinct = F.size(F.array_distinct("edges")) == len(_FIFTHS) + 2
        message = F.concat(F.lit("quintile edges coincide for "), F.col("metric"))
        edges = edges.withColumn("edges", F.when(distinct, F.col("edges")).otherwise(F.raise_error(message)))
    # Three rows, one per metric.
    by_metric = edges.agg(F.map_from_entries(F.collect_list(F.struct("metric", "edges")))).scalar()
    model = model.withColumn("_edges", by_metric)

    def score(metric: str) -> Column:
        inner = F.col("_edges")[metric]
        passed = F.lit(1)
        for i in range(1, len(_FIFTHS) + 1):
            passed = passed + (F.col(metric).cast("double") > inner[i]).cast("int")
        return passed

    scored = model.withColumns(
        {
            "r_score": 6 - score("recency_days"),
            "f_score": score("txn_count"),
            "m_score": score("value_success"),
        }
    ).drop("_edges")
    r, f, m = F.col("r_score"), F.col("f_score"), F.col("m_score")
    champion, loyal, at_risk, regular = fv.QUINTILE_SEGMENTS
    segment = (
        F.when(F.least(r, f, m) >= 4, champion)
        .when(F.least(r, f) >= 3, loyal)
        .when(r <= 2, at_risk)
        .otherwise(regular)
    )
    return scored.withColumn("rfm_segment", segment)


def rfm_quintile_summary(quintiles: DataFrame) -> DataFrame:
    return (
        quintiles.groupBy("rfm_segment")
        .agg(row_count().alias("customers"), round_to(F.sum("value_success"), 2).alias("total_value"))
        .orderBy(F.desc("total_value"), "rfm_segment")
    )
