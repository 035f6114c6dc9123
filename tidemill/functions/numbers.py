"""Dates, money and scores."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that stand for no number.
NO_NUMBER = ("", "n/a", "na", "none", "null", "-", "tbd")
#: Date patterns in the order they are tried.
DATE_PATTERNS = ("yyyy-M-d", "M/d/yyyy", "M-d-yyyy", "d/M/yyyy", "d-M-yyyy", "yyyy/M/d")


def parsed_decimal(text: Column) -> Column:
    """A decimal from a text after all but digits, point and minus have gone; null if it is none.

    Parentheses are dropped like other signs, so "(1,000)" is 1000, and "1.5M" is 1.5.
    """
    bare = F.regexp_replace(text, r"[^0-9.\-]", "")
    return F.when(~F.lower(F.trim(text)).isin(*NO_NUMBER), F.when(bare != "", bare)).try_cast("decimal(18,2)")


def parsed_int(text: Column) -> Column:
    """The whole part of a number in a text."""
    return F.regexp_replace(text, r"[^0-9.\-]", "").try_cast("double").try_cast("bigint")


def parsed_date(text: Column, patterns: Sequence[str] = DATE_PATTERNS) -> Column:
    """The date by the first pattern that fits; month before day where both do."""
    return F.coalesce(*(F.try_to_date(F.trim(text), p) for p in patterns))


def sum_of_present(*parts: Column) -> Column:
    """Sum of the parts that aren't null; null for none or a sum of zero."""
    total = sum((F.coalesce(p, F.lit(0)) for p in parts), F.lit(0))
    return F.nullif(total, F.lit(0))


def change_of_magnitude(old: Column, new: Column) -> Column:
    """Percent of the old value's magnitude; from zero it is 100, or 0 without a change."""
    return F.when(old == 0, F.when(new != 0, F.lit(100.0)).otherwise(F.lit(0.0))).otherwise(F.try_divide(new - old, F.abs(old)) * 100)


def change_signed(old: Column, new: Column) -> Column:
    """Percent of the old value with its sign; null from zero."""
    return F.try_divide(new - old, old) * 100


def severity(percent: Column, low: float = 5, medium: float = 20, closed: bool = True) -> Column:
    """low, medium or high by the size of a change; ``closed``: the bounds belong to the lower class."""
    p = F.abs(percent)
    below = (lambda b: p <= b) if closed else (lambda b: p < b)
    return F.when(percent.isNull(), F.lit(None).cast("string")).when(below(low), "low").when(below(medium), "medium").otherwise("high")


def delta_flag(field: Column, old: Column, new: Column) -> Column:
    """POSITIVE_CHANGE, NEGATIVE_CHANGE or NEUTRAL: more is better for limits, less for premiums and deductibles."""
    low = F.lower(field)
    more = low.contains("limit") | low.contains("coverage")
    less = low.contains("premium") | low.contains("deductible") | low.contains("price")
    better = (more & (new > old)) | (less & (new < old))
    worse = (more & (new < old)) | (less & (new > old))
    return F.when(better, "POSITIVE_CHANGE").when(worse, "NEGATIVE_CHANGE").otherwise("NEUTRAL")


def advantage(a: Column, b: Column, higher: bool) -> Column:
    """Which of two values is better; a missing one loses, two missing or equal ones tie."""
    one, two = (a > b, b > a) if higher else (a < b, b < a)
    return F.when(a.isNull() & b.isNull(), "tie").when(b.isNull() | one, "one").when(a.isNull() | two, "two").otherwise("tie")


def quality_score(limit: Column, reference: Column, penalties: Column, weight: float = 0.8, penalty: float = 0.3) -> Column:
    """0 to 10: one, plus the limit's share of the reference, less penalties, times ten."""
    raw = (1 + weight * F.least(limit / reference, F.lit(1.0)) - penalty * penalties) * 10
    return F.greatest(F.lit(0.0), F.least(F.lit(10.0), raw))


def recency(day: Column, as_of: Column, most: float = 0.05, days: int = 365) -> Column:
    """A boost that falls to zero at ``days`` days either way."""
    gap = F.abs(F.datediff(as_of, day))
    return F.when(gap < days, most * (1 - gap / float(days))).otherwise(F.lit(0.0))


def recency_signed(day: Column, as_of: Column, most: float = 0.05, days: int = 365) -> Column:
    """As :func:`recency` with a signed gap: days to come get more than ``most``."""
    gap = F.datediff(as_of, day)
    return F.when(gap < days, most * (1 - gap / float(days))).otherwise(F.lit(0.0))


def about_a_year(a: Column, b: Column) -> Column:
    return F.abs(F.datediff(a, b)).between(360, 370)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine in double precision; null where a vector is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return 1 - F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def money(amount: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(amount, 2))
