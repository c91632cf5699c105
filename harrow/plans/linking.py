"""Link applications to cases: clean, group, represent, link, re-expand."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrow.functions.strings import clean_company_name, is_blank
from harrow.operators import filters, groups, linkage
from harrow.session import cut_lineage


@dataclass(frozen=True)
class Side:
    """Column names of one table: row id, name, city, state, and the date that
    picks a group's representative."""

    row_id: str
    name: str
    city: str
    state: str
    date: str


def prepared(df: DataFrame, side: Side, fallback_state: str | None = None, clean=clean_company_name) -> DataFrame:
    """Named rows with ``name``, ``city`` and ``state`` ready for matching."""
    state: Column = F.col(side.state)
    if fallback_state:
        state = F.when(is_blank(state), F.col(fallback_state)).otherwise(state)
    named = df.where(~is_blank(F.col(side.name)))
    return named.withColumns({"_name": clean(F.col(side.name)), "_city": F.upper(F.col(side.city)), "_state": state})


def grouped(df: DataFrame, side: Side, group: str, cut: float) -> DataFrame:
    """Rows with the id of their employer group inside a state."""
    found = linkage.dedupe_values(df, "_name", ["_state"], cut, "_group_name")
    own = F.coalesce(F.col("_group_name"), F.concat(F.lit("row "), F.col(side.row_id).cast("string")))
    return found.withColumn(group, F.concat_ws("|", F.coalesce("_state", F.lit("")), own)).drop("_group_name")


def representatives(df: DataFrame, side: Side, group: str) -> DataFrame:
    return groups.earliest_of_group(df, group, side.date, side.row_id)


def link_records(
    jobs: DataFrame,
    cases: DataFrame,
    job_side: Side,
    case_side: Side,
    fallback_state: str | None = None,
    group_cut: float = 0.94,
    agree: float = 0.94,
    partial: float = 0.88,
    threshold: float = 0.85,
    clean=clean_company_name,
) -> dict[str, DataFrame]:
    """The whole chain.

    Result: ``links`` (job group, case group, posterior) and ``expanded``, every
    job row with every case row its group matched. Groups are formed inside a
    state, so a group never spans two.
    """
    fields = ["_name", "_city"]
    j = cut_lineage(grouped(prepared(jobs, job_side, fallback_state, clean), job_side, "job_group", group_cut))
    c = cut_lineage(grouped(prepared(cases, case_side, None, clean), case_side, "case_group", group_cut))
    linked = linkage.link_tables(
        representatives(j, job_side, "job_group").select("job_group", "_state", *fields),
        representatives(c, case_side, "case_group").select("case_group", "_state", *fields),
        "job_group", "case_group", ["_state"], fields, agree, partial, threshold,
    )
    links = cut_lineage(linked.where("is_matched").select("job_group", "case_group", "posterior"))
    expanded = linkage.expand_matches(
        j.drop("_name", "_city", "_state"), c.drop("_name", "_city", "_state"), links, "job_group", "case_group"
    )
    return {"jobs": j, "cases": c, "links": links, "expanded": expanded}


def approved_jobs(df: DataFrame, status: str, kept=("- CERTIFICATION", "- PARTIAL CERTIFICATION")) -> DataFrame:
    return filters.with_status(df, status, kept)


def relevant_cases(df: DataFrame, act: str, acts: list[str], code: str, jobs: DataFrame, job_code: str) -> DataFrame:
    """Cases under the listed acts whose industry code is agricultural or occurs among the jobs."""
    return filters.pattern_or_member(df.where(F.col(act).isin(acts)), code, "^11", jobs, job_code)
