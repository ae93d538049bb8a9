"""Explainable selection rules scored against the review flag."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens import fixed_values as fv
from ledgerlens.functions.exprs import flagged, is_international, pct, ratio, round_to, row_count


def widening_rules(
    amount: float = fv.RULE_AMOUNT, types: Sequence[str] = fv.RULE_TYPES, labels: Sequence[str] = fv.RULE_LABELS
) -> dict[str, Column]:
    """Three rules, each admitting whatever the one before it does."""
    large = F.col("amount") >= amount
    or_abroad = large | is_international()
    return dict(zip(labels, (large, or_abroad, or_abroad | F.col("txn_type").isin(*types))))


def rule_scorecard(ledger: DataFrame, rules: Mapping[str, Column] | None = None) -> DataFrame:
    """Volume, precision, recall and lift per rule from a single pass over the ledger."""
    rules = widening_rules() if rules is None else rules
    counts = [
        F.struct(
            F.lit(label).alias("rule"),
            F.count_if(selected).alias("txns_selected"),
            F.count_if(selected & flagged()).alias("hits"),
        )
        for label, selected in rules.items()
    ]
    totals = ledger.agg(
        row_count().alias("rows"), F.count_if(flagged()).alias("flags"), F.array(*counts).alias("per_rule")
    )
    picked, hits = F.col("txns_selected"), F.col("hits")
    return totals.select("rows", "flags", F.inline("per_rule")).select(
        "rule",
        "txns_selected",
        pct(picked, F.col("rows"), 1).alias("pct_of_volume"),
        pct(hits, picked, 1).alias("precision_pct"),
        pct(hits, F.col("flags"), 1).alias("recall_pct"),
        round_to(ratio(ratio(hits, picked), ratio(F.col("flags"), F.col("rows"))), 2).alias("lift"),
    )
