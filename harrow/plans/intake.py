"""Legal-aid intake: settle the opponent, merge two pulls, keep employers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.functions.strings import first_present
from harrow.operators import aggregates, filters, joins
from harrow.operators.text_columns import zip_split

# Disposition codes of the second pull.
DISPOSITIONS = {"CLO": "Closed", "PEN": "Pending", "ACC": "Open"}


def settle_opponent(df: DataFrame, names: Sequence[tuple[str, str]], states: Sequence[str], out=("opponent", "opponent_source", "opponent_state")) -> DataFrame:
    """First filled opponent column with its source, and first filled state."""
    value, label = first_present([(F.col(c), text) for c, text in names], "Missing all")
    return df.withColumns({out[0]: value, out[1]: label, out[2]: F.coalesce(*[F.col(c) for c in states])})


def spread_opponents(df: DataFrame, opponents: str, states: str) -> DataFrame:
    """One row per opponent of the second pull: names split at carriage
    returns, states at commas, rows with unequal lists left out."""
    return zip_split(df, {opponents: "\r", states: ","}, ["opponent", "opponent_state"])


def disposition(own: str, code: str):
    chain = F.when(F.col(own).isNotNull(), F.col(own))
    for k, v in DISPOSITIONS.items():
        chain = chain.when(F.col(code) == k, F.lit(v))
    return chain.otherwise(F.lit("Unknown dispo"))


def merge_pulls(
    first: DataFrame, second: DataFrame, key: str, date: str, since: str, columns: Sequence[str] = ("opponent", "opponent_state"),
) -> DataFrame:
    """Both pulls since a date, the first winning, with per-case missing flags.

    The first pull is cut before the merge and the second where it adds cases.
    """
    a = filters.in_period(first, date, since)
    only = joins.rows_without(filters.in_period(second, date, since), a, [key])
    shared = joins.rows_with(second, a, [key])
    merged = joins.precedence_merge(
        a, shared.unionByName(only), key, [date, *columns], columns[0], ("first", "second"), "source"
    )
    return aggregates.all_missing_flags(merged, key, list(columns))


def employers_only(merged: DataFrame, key: str, columns: Sequence[str] = ("opponent", "opponent_state"), date: str = "date") -> DataFrame:
    """Cases with an opponent and a state, institutions out, repeated rows once."""
    known = merged.where(~F.col(f"all_{columns[0]}_missing") & ~F.col(f"all_{columns[1]}_missing"))
    kept = filters.without_institutions(known, columns[0])
    return kept.select(key, date, *columns).dropDuplicates()
