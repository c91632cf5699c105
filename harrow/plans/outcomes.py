"""Outcome tables from linked records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from harrow.functions.flags import settled, two_source_category, window_outcomes


def case_outcomes(linked: DataFrame, matched: str, found: str, start: str, end: str, counts: Sequence[str]) -> DataFrame:
    """Adds the window flags; ``counts``: main count, then further counts."""
    flags = window_outcomes(
        F.col(matched), F.col(found), F.col(start), F.col(end), F.col(counts[0]), tuple(F.col(c) for c in counts[1:])
    )
    return linked.withColumns(flags)


def intake_outcomes(linked: DataFrame, matched: str, date: str, start: str) -> DataFrame:
    """Flags for a source with single dates instead of spans."""
    return linked.withColumns({
        "any_intake": settled(F.col(matched)),
        "intake_after_start": settled(F.col(matched) & (F.col(date) >= F.col(start))),
        "intake_before_start": settled(F.col(matched) & (F.col(date) < F.col(start))),
    })


def per_job(outcomes: DataFrame, job: str, flags: Sequence[str]) -> DataFrame:
    """One row per job: a flag holds when any of the job's rows has it."""
    return outcomes.groupBy(job).agg(*[F.bool_or(F.col(f)).alias(f) for f in flags])


def compare_sources(first: DataFrame, second: DataFrame, job: str, a: str, b: str, names: tuple[str, str]) -> DataFrame:
    """Category of two sources per job; jobs the second source lacks count as not flagged by it."""
    joined = first.join(second, job, "left")
    return joined.withColumn("source_category", two_source_category(F.col(a), F.col(b), *names))


def windows_with_event(jobs: DataFrame, events: DataFrame, group: str, start: str, end: str, day: str, out: str) -> DataFrame:
    """Whether an event of the job's group falls in the job's window.

    For each distinct start the group's next event day is found, and the job
    is flagged when that day is not after its end. Only distinct days of a
    group meet in a window, so its size is bounded by the calendar and a
    group's jobs are never paired with its events.
    """
    known = events.select(group, F.col(day).alias("_day"), F.col(day).alias("_event"))
    starts = jobs.select(group, F.col(start).alias("_day"), F.lit(None).cast(known.schema["_event"].dataType).alias("_event"))
    days = known.unionByName(starts).where(F.col("_day").isNotNull()).groupBy(group, "_day").agg(F.max("_event").alias("_event"))
    onward = Window.partitionBy(group).orderBy("_day").rowsBetween(0, Window.unboundedFollowing)
    upcoming = days.select(
        F.col(group).alias("_group"), "_day", F.first("_event", ignorenulls=True).over(onward).alias("_next")
    ).where(F.col("_next").isNotNull())
    joined = jobs.join(upcoming, (jobs[group] == upcoming["_group"]) & (jobs[start] == upcoming["_day"]), "left")
    return joined.withColumn(out, F.coalesce(F.col("_next") <= F.col(end), F.lit(False))).drop("_group", "_day", "_next")
