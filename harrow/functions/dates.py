"""Date and time columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Textual date forms met in the sources.
SLASH_DATE = "M/d/yyyy"
LONG_DATE = "MMMM d, yyyy"
COMPACT_DATE = "ddMMMyyyy"
ISO_DATE = "yyyy-MM-dd"

QUARTER_END = {1: "MAR", 2: "JUN", 3: "SEP", 4: "DEC"}


def parse_date(c: Column, *formats: str) -> Column:
    """First format that reads the text; null when none does."""
    return F.coalesce(*[F.try_to_date(c, f) for f in formats or (ISO_DATE,)])


def leading_date(c: Column) -> Column:
    """ISO date at the head of text such as ``2019-03-01 00:00:00.000000``."""
    return F.try_to_date(F.substring(c, 1, 10), ISO_DATE)


def month_floor(c: Column) -> Column:
    return F.trunc(c, "month")


def quarter_label(c: Column) -> Column:
    """MAR, JUN, SEP or DEC: the month that ends the quarter."""
    q = F.quarter(c)
    chain = F.when(q == 1, F.lit(QUARTER_END[1]))
    for n in (2, 3, 4):
        chain = chain.when(q == n, F.lit(QUARTER_END[n]))
    return chain


def label_quarter(c: Column) -> Column:
    """Quarter number of a quarter-end label."""
    chain = F.when(c == QUARTER_END[1], F.lit(1))
    for n in (2, 3, 4):
        chain = chain.when(c == QUARTER_END[n], F.lit(n))
    return chain


def quarter_index(year: Column, quarter: Column) -> Column:
    """Running quarter number, so that neighbours differ by one."""
    return year * 4 + quarter - 1


def ordinal_day(c: Column) -> Column:
    """Day number with 0001-01-01 as 1, as a long."""
    return (F.datediff(c, F.lit("0001-01-01").cast("date")) + 1).cast("long")


def drop_zone(c: Column) -> Column:
    """Wall-clock time of the session zone, without a zone."""
    return c.cast("timestamp_ntz")


def in_range_flag(c: Column, start, end) -> Column:
    """1 inside the closed range, 0 outside, null for a null date."""
    return c.between(start, end).cast("int")
