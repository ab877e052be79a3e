"""Numeric expressions: coercion, ratios, growth, buckets, forecast formulas."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerline.settings import (
    DECAY_HALF_LIFE,
    GROWTH_CUT,
    NO_VALUE,
    TREND_EVIDENCE,
    Z_SCORE,
)

NUMBER_TEXT = r"(?i)^\s*[+-]?(\d+\.?\d*(e[+-]?\d+)?|\.\d+(e[+-]?\d+)?|inf(inity)?)\s*$"


def not_nan(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def number_of(text: Column) -> Column:
    """Number in a text or numeric column, null where it is none."""
    as_text = text.cast("string")
    return F.when(as_text.rlike(NUMBER_TEXT), as_text.try_cast("double"))


def is_finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def currency(text: Column) -> Column:
    return number_of(F.when(text.cast("string") != NO_VALUE, text))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where the result is not a finite number."""
    q = F.try_divide(a, b)
    return F.when(is_finite(q), q)


def log_growth(now: Column, before: Column) -> Column:
    """Log of the ratio, so that equal ratios are equal growth and one of just 1.1 meets its cut."""
    return F.log(F.try_divide(1 + now, F.when(before > -1, 1 + before)))


def non_negative(x: Column) -> Column:
    return F.when(x >= 0, x)


def age(year: Column, founded: Column) -> Column:
    return non_negative(year - founded)


def recency(year: Column, event: Column) -> Column:
    """Years since the event; null before it, so later events never show."""
    return non_negative(year - F.year(event))


def size_bucket(employees: Column) -> Column:
    return (
        F.when(employees < 10, "Micro")
        .when(employees < 50, "Small")
        .when(employees < 250, "Medium")
        .when(employees.isNotNull(), "Large")
    )


def primary_code(codes: Column) -> Column:
    return number_of(F.get(F.split(codes, ","), 0))


def filled(columns: list[Column]) -> Column:
    """How many of the columns hold a value."""
    total = F.lit(0)
    for c in columns:
        total = total + c.isNotNull().cast("int")
    return total


def mean_of(columns: list[Column]) -> Column:
    """Row mean over the non-null columns, null where none is filled."""
    total = F.lit(0.0)
    for c in columns:
        total = total + F.coalesce(c.cast("double"), F.lit(0.0))
    return F.try_divide(total, filled(columns).cast("double"))


def stddev_of(columns: list[Column]) -> Column:
    """Sample standard deviation over the non-null columns, null below two."""
    mean = mean_of(columns)
    squares = F.lit(0.0)
    for c in columns:
        squares = squares + F.coalesce((c - mean) * (c - mean), F.lit(0.0))
    n = filled(columns)
    return F.when(n > 1, F.sqrt(squares / (n - 1)))


def median_of_three(a: Column, b: Column, c: Column) -> Column:
    """Median of the non-null values among three columns."""
    middle = F.greatest(F.least(a, b), F.least(F.greatest(a, b), c))
    return F.when(filled([a, b, c]) == 3, middle).otherwise(mean_of([a, b, c]))


def horizon_bucket(target_year: Column, cutoff: Column) -> Column:
    ahead = target_year - cutoff
    return F.when(ahead >= 4, "4+").otherwise(ahead.cast("int").cast("string"))


def growth_bucket(growth: Column) -> Column:
    # Bucket labels.
    return (
        F.when(growth > GROWTH_CUT, "growing (>=10% YoY)")
        .when(growth < -GROWTH_CUT, "declining (<=-10% YoY)")
        .when(growth.isNotNull(), "flat (-10% to +10%)")
        .otherwise("insufficient_history (no lag_1)")
    )


def growth_signal(mean_3y: Column, last: Column) -> Column:
    signal = F.coalesce(mean_3y, last)
    return F.when(signal > GROWTH_CUT, "growing").otherwise("stable")


def gated_growth(signal: Column, evidence: Column) -> Column:
    """Trend routing needs both a growing signal and the best evidence group."""
    return F.when((signal == "growing") & (evidence == TREND_EVIDENCE), "growing").otherwise("stable")


def evidence_group(n_years: Column, source: Column) -> Column:
    n = F.coalesce(n_years, F.lit(0))
    return (
        F.when(n >= 3, "A")
        .when(n == 2, "B")
        .when(n == 1, "C")
        .when((n == 0) & (source == "estimated"), "D")
        .otherwise("UNCLASSIFIED")
    )


def grown(turnover: Column, growth: Column) -> Column:
    return F.expm1(F.log1p(turnover) + growth)


def cagr_growth(mean_3y: Column, mean_2y: Column, last: Column) -> Column:
    return F.coalesce(mean_3y, mean_2y, last, F.lit(0.0))


def decayed(turnover: Column, raw: Column, step: Column, anchor: Column) -> Column:
    """Pull the implied growth of a raw forecast towards the anchor by step."""
    own = F.pow(F.lit(0.5), step / F.lit(DECAY_HALF_LIFE))
    blended = own * log_growth(raw, turnover) + (F.lit(1.0) - own) * anchor
    return grown(turnover, blended)


def interval(turnover: Column, sigma: Column, step: Column) -> tuple[Column, Column]:
    """Lower and upper bound; the log half-width grows with the root of the step."""
    half = F.lit(Z_SCORE) * sigma * F.sqrt(step)
    lower = F.greatest(F.expm1(F.log1p(turnover) - half), F.lit(0.0))
    upper = F.expm1(F.log1p(turnover) + half)
    known = sigma.isNotNull() & turnover.isNotNull()
    return F.when(known, lower), F.when(known, upper)
