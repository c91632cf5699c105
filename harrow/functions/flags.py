"""Outcome flags, categories and guarded numbers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def settled(condition: Column) -> Column:
    """Unknown counts as false."""
    return F.coalesce(condition, F.lit(False))


def indicator(condition: Column) -> Column:
    return condition.cast("int")


def ratio(numerator: Column, denominator: Column) -> Column:
    """Null for a zero or null denominator."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def zero_if_missing(c: Column) -> Column:
    return F.coalesce(c, F.lit(0))


def sentinel_to_null(c: Column) -> Column:
    """Negative codes stand for missing."""
    return F.when(c >= 0, c)


def zero_to_null(c: Column) -> Column:
    return F.when(c != 0, c)


def half_even(c: Column, digits: int = 0) -> Column:
    return F.bround(c, digits)


def window_outcomes(
    matched: Column,
    found: Column,
    start: Column,
    end: Column,
    violations: Column,
    other_counts: tuple[Column, ...] = (),
) -> dict[str, Column]:
    """Relations between a finding's date and the window it may fall in."""
    inside = matched & (found >= start) & (found <= end)
    flags = {
        "any_finding": settled(matched),
        "finding_after_start": settled(matched & (found >= start)),
        "finding_before_start": settled(matched & (found < start)),
        "finding_in_window": settled(inside),
        "violation_in_window": settled(inside & (violations > 0)),
    }
    if other_counts:
        # all counts but the last are compared with zero; the last counts when non-zero
        hits = [violations > 0, *[c > 0 for c in other_counts[:-1]], other_counts[-1] != 0]
        flags["any_violation_in_window"] = settled(inside & reduce(lambda a, b: a | b, hits))
    return flags


def two_source_category(a: Column, b: Column, a_name: str, b_name: str) -> Column:
    """Which of two sources raised a flag; a null second flag falls to neither."""
    return (
        F.when(a & b, F.lit(f"Both {a_name} and {b_name}"))
        .when(a & ~b, F.lit(f"{a_name}; not {b_name}"))
        .when(~a & b, F.lit(f"{b_name}; not {a_name}"))
        .otherwise(F.lit(f"Neither {a_name} nor {b_name}"))
    )


def coefficient_category(a: Column, b: Column, a_name: str, b_name: str, small: float = 0.1) -> Column:
    """Agreement of two effects; an exact zero beside a large effect has no category."""
    return (
        F.when((F.abs(a) < small) & (F.abs(b) < small), F.lit("Small both"))
        .when((a > 0) & (b > 0), F.lit("Higher risk both"))
        .when((a < 0) & (b < 0), F.lit("Lower risk both"))
        .when((a > 0) & (b < 0), F.lit(f"Higher risk {a_name}"))
        .when((a < 0) & (b > 0), F.lit(f"Higher risk {b_name}"))
    )


def hit_category(predicted: Column, actual: Column) -> Column:
    return (
        F.when(predicted & actual, F.lit("TP"))
        .when(predicted & ~actual, F.lit("FP"))
        .when(~predicted & actual, F.lit("FN"))
        .when(~predicted & ~actual, F.lit("TN"))
    )


def predicted_side(category: Column) -> Column:
    """Side of the cut a review row is on: categories with a P were predicted positive."""
    return F.when(category.contains("P"), F.lit("predicted positive")).otherwise(F.lit("predicted negative"))
