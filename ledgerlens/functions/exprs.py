"""Column helpers: rounding, rates, bands, calendar differences, normal-tail probability.

Everything here is a built-in Spark expression, so it stays inside generated code.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlens import fixed_values as fv

_EXACT_INTEGERS = float(2**52)


def round_to(value: Column, digits: int) -> Column:
    """Round half away from zero on the binary value, as C `round` does.

    Spark's own `round` works on the decimal text of a double (1.005 -> 1.01),
    which disagrees with SQL engines that round the binary product (-> 1.0).
    """
    value = value.cast("double")
    scale = float(10**digits)
    scaled = F.abs(value) * scale
    rounded = F.signum(value) * F.floor(scaled + 0.5) / scale
    # Above 2^52 a double has no fraction left to round.
    return F.when(scaled < _EXACT_INTEGERS, rounded).otherwise(value)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Double division that is NULL, not an error, over zero."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def pct(part: Column, whole: Column, digits: int = 2) -> Column:
    return round_to(F.try_divide(F.lit(100.0) * part.cast("double"), whole.cast("double")), digits)


def row_count() -> Column:
    return F.count(F.lit(1))


def successful() -> Column:
    return F.col("status") == fv.SUCCESSFUL


def failed() -> Column:
    return F.col("status") == fv.FAILED


def flagged() -> Column:
    return F.col("risk_flag") == fv.YES


def is_international() -> Column:
    return F.col("international") == fv.YES


def band(value: Column, cuts: Sequence[float], labels: Sequence[str], *, inclusive: bool = False) -> Column:
    """Label of the first cut the value stays under (or at, when inclusive); the last label beyond."""
    if len(labels) != len(cuts) + 1:
        raise ValueError("a band needs one label more than it has cuts")
    (first_cut, *more_cuts), (first_label, *more_labels) = cuts, labels
    below = (lambda cut: value <= cut) if inclusive else (lambda cut: value < cut)
    chain = F.when(below(first_cut), first_label)
    for cut, label in zip(more_cuts, more_labels):
        chain = chain.when(below(cut), label)
    return chain.otherwise(labels[-1])


def month_label(ts: Column) -> Column:
    return F.date_format(F.to_date(ts), "yyyy-MM")


def minute_index(ts: Column) -> Column:
    """Minutes from the epoch to the minute the timestamp lies in.

    The difference of two indexes counts minute boundaries crossed. Day, hour and
    minute of a zone-less timestamp do not pass through the session time zone.
    """
    days = F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("bigint")
    return days * 1_440 + F.hour(ts) * 60 + F.minute(ts)


def whole_days_between(start: Column, end: Column) -> Column:
    """Completed 24-hour days, not date boundaries."""
    return F.date_part(F.lit("DAY"), end - start).cast("bigint")


def binomial_tail(p: Column, trials: int, at_least: int) -> Column:
    """P(X >= at_least) for X ~ Binomial(trials, p)."""
    below = [
        F.lit(float(math.comb(trials, hits))) * F.pow(p, F.lit(hits)) * F.pow(1 - p, F.lit(trials - hits))
        for hits in range(at_least)
    ]
    tail = F.lit(1.0)
    for term in below:
        tail = tail - term
    return tail


def erfc(x: Column) -> Column:
    """Complementary error function for x >= 0.

    Below 2.5 the all-positive series of erf, beyond it the continued fraction
    (Abramowitz & Stegun 7.1.6 and 7.1.14).
    """
    root_pi = math.sqrt(math.pi)
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(60)),
        F.struct(x.alias("term"), x.alias("total")),
        lambda acc, n: F.struct(
            (acc["term"] * 2 * x * x / (2 * n + 1)).alias("term"),
            (acc["total"] + acc["term"] * 2 * x * x / (2 * n + 1)).alias("total"),
        ),
        lambda acc: acc["total"],
    )
    fraction = F.aggregate(
        F.sequence(F.lit(60), F.lit(1), F.lit(-1)),
        x,
        lambda acc, n: x + (n / 2.0) / acc,
    )
    decay = F.exp(-x * x)
    return F.when(x < 2.5, 1 - 2 / root_pi * decay * series).otherwise(decay / root_pi / fraction)


def chi2_tail(x: Column, dof: Column) -> Column:
    """P(X >= x) for a chi-square variable with a whole number of degrees of freedom.

    Q(s, h) = Q(s - 1, h) + h^(s-1) e^(-h) / gamma(s) from s = 1/2 (erfc) or s = 1 (exp).
    """
    h = x / 2
    odd = dof % 2 == 1
    start = F.when(odd, erfc(F.sqrt(h))).otherwise(F.exp(-h))
    first = F.when(odd, 2 * F.sqrt(h / math.pi) * F.exp(-h)).otherwise(h * F.exp(-h))
    offset = F.when(odd, -0.5).otherwise(0.0)
    steps = F.floor((dof - 1) / 2).cast("int")
    summed = F.aggregate(
        F.when(steps > 0, F.sequence(F.lit(1), steps)).otherwise(F.array().cast("array<int>")),
        F.struct(first.alias("term"), F.lit(0.0).alias("total")),
        lambda acc, i: F.struct(
            (acc["term"] * h / (i + 1 + offset)).alias("term"), (acc["total"] + acc["term"]).alias("total")
        ),
        lambda acc: acc["total"],
    )
    return F.when(dof == 0, F.lit(1.0)).otherwise(start + summed)
