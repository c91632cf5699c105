"""Linking and deduplicating records with dirty names.

Everything runs on distinct (block, fields) combinations that carry their row
counts. A pair of rows is only written where the result asks for it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrow.functions.similarity import jaro_winkler
from harrow.operators.aggregates import first_of_duplicates
from harrow.operators.candidates import similar_values
from harrow.operators.groups import split_groups_by
from harrow.operators.joins import join_many
from harrow.session import cut_lineage

MISSING, DISAGREE, PARTIAL, AGREE = -1, 0, 1, 2

#: Edges of a node that are brought together, and nodes with more that are looked up at most.
HUB_ROWS, HUBS = 100_000, 10_000


def combinations(df: DataFrame, block: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Distinct block and field values with their row count; null blocks drop.

    Written once, as the steps of a linkage read them many times.
    """
    known = df.dropna(subset=list(block)) if block else df
    blank_free = [F.when(F.length(f) > 0, F.col(f)).alias(f) for f in fields]
    return cut_lineage(known.select(*block, *blank_free).groupBy(*block, *fields).agg(F.count("*").alias("weight")))


class SimilarFields:
    """The similar values of each field of two tables (or one), found once for all steps of a linkage.

    A step on part of the combinations may read them too, as values that it lacks join nothing.
    """

    def __init__(self, left: DataFrame, right: DataFrame | None, block: Sequence[str], cut: float):
        self._sides, self._cut, self._found = (left, right, block), cut, {}

    def of(self, field: str) -> DataFrame:
        if field not in self._found:
            self._found[field] = cut_lineage(similar_values(*self._sides, field, self._cut))
        return self._found[field]


def _pairs_by(
    left: DataFrame, right: DataFrame | None, block: Sequence[str], fields: Sequence[str], lead: str, values: DataFrame
) -> DataFrame:
    """Combination pairs whose ``lead`` values are listed in ``values`` (``similar_values``), with their similarity.

    Columns: block, ``<field>_l``, ``<field>_r``, ``weight_l``, ``weight_r``,
    ``jw_<lead>``. In a self match each unordered pair of different
    combinations occurs once.
    """
    names = {f"{f}": f"{f}_l" for f in [*fields, "weight"]}
    a = left.withColumnsRenamed(names)
    b = (left if right is None else right).withColumnsRenamed({f: f"{f}_r" for f in [*fields, "weight"]})
    values = values.withColumnsRenamed(
        {"left_value": f"{lead}_l", "right_value": f"{lead}_r", "similarity": f"jw_{lead}"}
    )
    pairs = a.join(values, [*block, f"{lead}_l"]).join(b, [*block, f"{lead}_r"])
    if right is None:
        # same lead value, different other fields
        others = [f for f in fields if f != lead]
        if others:
            same = a.where(F.col(f"{lead}_l").isNotNull()).join(
                b.withColumn(f"{lead}_l", F.col(f"{lead}_r")), [*block, f"{lead}_l"]
            )
            rest_l = F.to_json(F.struct(*[F.col(f"{f}_l").alias(f) for f in others]))
            rest_r = F.to_json(F.struct(*[F.col(f"{f}_r").alias(f) for f in others]))
            same = same.where(rest_l < rest_r).withColumn(f"jw_{lead}", F.lit(1.0))
            pairs = pairs.unionByName(same)
    return pairs


def score_fields(pairs: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Adds ``jw_<field>`` where it is not there yet."""
    new = {f"jw_{f}": jaro_winkler(F.col(f"{f}_l"), F.col(f"{f}_r")) for f in fields if f"jw_{f}" not in pairs.columns}
    return pairs.withColumns(new) if new else pairs


def agreement(score: Column, agree: float, partial: float) -> Column:
    """2 agree, 1 partly, 0 not, -1 when a side is missing."""
    return (
        F.when(score.isNull(), F.lit(MISSING))
        .when(score >= agree, F.lit(AGREE))
        .when(score >= partial, F.lit(PARTIAL))
        .otherwise(F.lit(DISAGREE))
    )


def add_agreement(pairs: DataFrame, fields: Sequence[str], agree: float, partial: float) -> DataFrame:
    return pairs.withColumns({f"level_{f}": agreement(F.col(f"jw_{f}"), agree, partial) for f in fields})


def fuzzy_join(
    left: DataFrame, right: DataFrame, block: Sequence[str], fields: Sequence[str], cut: float = 0.85
) -> DataFrame:
    """Combinations that agree on the block and reach the cut on every field.

    Columns: block, ``<field>_l``, ``<field>_r``, ``jw_<field>``, ``weight_l``,
    ``weight_r``. ``expand_pairs`` turns them into row pairs.
    """
    a, b = combinations(left, block, fields), combinations(right, block, fields)
    values = similar_values(a, b, block, fields[0], cut)
    pairs = score_fields(_pairs_by(a, b, block, fields, fields[0], values), fields)
    return reduce(lambda d, f: d.where(F.col(f"jw_{f}") >= cut), fields[1:], pairs)


def expand_pairs(
    pairs: DataFrame, left: DataFrame, right: DataFrame, block: Sequence[str], fields: Sequence[str],
    left_id: str, right_id: str,
) -> DataFrame:
    """Row pairs of matched combinations."""
    a = left.select(left_id, *block, *[F.col(f).alias(f"{f}_l") for f in fields])
    b = right.select(right_id, *block, *[F.col(f).alias(f"{f}_r") for f in fields])
    joined = pairs.drop("weight_l", "weight_r").join(a, [*block, *[f"{f}_l" for f in fields]])
    return joined.join(b, [*block, *[f"{f}_r" for f in fields]])


# Pattern counts


def _all_pairs(left: DataFrame, right: DataFrame | None, block: Sequence[str]) -> DataFrame:
    """One row: the number of row pairs in all blocks."""
    n = left.groupBy(*block).agg(F.sum("weight").alias("_l"))
    if right is None:
        return n.agg(F.sum(F.col("_l") * (F.col("_l") - 1) / 2).cast("long").alias("pairs"))
    m = right.groupBy(*block).agg(F.sum("weight").alias("_r"))
    both = n.join(m, list(block)) if block else n.crossJoin(m)  # one row each without a block
    return both.agg(F.sum(F.col("_l") * F.col("_r")).cast("long").alias("pairs"))


def _narrow(df: DataFrame, block: Sequence[str], fields: Sequence[str]) -> DataFrame:
    return df.groupBy(*block, *fields).agg(F.sum("weight").alias("weight"))


def _near_pairs(left, right, block, fields, agree, partial, similar: SimilarFields) -> DataFrame:
    """Pattern counts of the row pairs whose first field agrees or partly agrees."""
    lead = fields[0]
    pairs = add_agreement(
        score_fields(_pairs_by(left, right, block, fields, lead, similar.of(lead)), fields), fields, agree, partial
    )
    levels = [f"level_{f}" for f in fields]
    counts = pairs.groupBy(*levels).agg(F.sum(F.col("weight_l") * F.col("weight_r")).alias("pairs"))
    if right is None:
        # pairs of rows with one and the same combination
        own = left.where(F.col(lead).isNotNull()).select(
            *[F.when(F.col(f).isNull(), F.lit(MISSING)).otherwise(F.lit(AGREE)).alias(f"level_{f}") for f in fields],
            (F.col("weight") * (F.col("weight") - 1) / 2).cast("long").alias("pairs"),
        )
        counts = counts.unionByName(own.where("pairs > 0"))
        counts = counts.groupBy(*levels).agg(F.sum("pairs").alias("pairs"))
    return counts


def pattern_counts(
    left: DataFrame, right: DataFrame | None, block: Sequence[str], fields: Sequence[str],
    agree: float = 0.94, partial: float = 0.88, similar: SimilarFields | None = None,
) -> DataFrame:
    """Row pairs per agreement pattern over all pairs of all blocks.

    Only pairs close on a field are formed. Pairs that are not close on the
    first field are counted by difference: all pairs by the other fields, less
    the close ones, less those where the first field is missing.

    ``left`` and ``right`` are ``combinations``.
    """
    if not fields:
        return _all_pairs(left, right, block)
    similar = similar or SimilarFields(left, right, block, min(agree, partial))
    lead, others = fields[0], list(fields[1:])
    levels, other_levels = [f"level_{f}" for f in fields], [f"level_{f}" for f in others]

    def without_lead(df):
        return None if df is None else _narrow(df, block, others)

    def with_lead(df):
        return None if df is None else df.where(F.col(lead).isNotNull())

    near = cut_lineage(_near_pairs(left, right, block, fields, agree, partial, similar))
    every = pattern_counts(without_lead(left), without_lead(right), block, others, agree, partial, similar)
    if any(df is not None and not df.where(F.col(lead).isNull()).isEmpty() for df in (left, right)):
        known = pattern_counts(
            without_lead(with_lead(left)), without_lead(with_lead(right)), block, others, agree, partial, similar
        )
    else:
        known = every

    def part(df, level, sign):
        return df.select(
            F.lit(level).alias(f"level_{lead}"), *other_levels, (F.col("pairs") * sign).alias("pairs")
        )

    signed = [
        near.select(*levels, "pairs"),
        part(known, DISAGREE, 1),
        part(near, DISAGREE, -1),
        part(every, MISSING, 1),
        part(known, MISSING, -1),
    ]
    total = reduce(DataFrame.unionByName, signed).groupBy(*levels).agg(F.sum("pairs").cast("long").alias("pairs"))
    return cut_lineage(total.where("pairs > 0"))


# Expectation-maximisation on the pattern table


@dataclass(frozen=True)
class LinkModel:
    """Share of matches and the level probabilities of both classes."""

    match_share: float
    matched: dict[str, dict[int, float]]
    unmatched: dict[str, dict[int, float]]

    def posterior(self, pattern: dict[str, int]) -> float:
        m, u = self.match_share, 1 - self.match_share
        for field, level in pattern.items():
            if level != MISSING:
                m *= self.matched[field].get(level, 1e-12)
                u *= self.unmatched[field].get(level, 1e-12)
        return m / (m + u) if m + u else 0.0


def fit_link_model(patterns: Sequence[tuple[dict[str, int], float]], rounds: int = 20_000, tol: float = 1e-9) -> LinkModel:
    """Mixture of matches and non-matches fitted to pattern counts.

    It starts from the pairs that agree on every known field. The same pairs
    weigh a prior that keeps the matched class one of agreeing pairs: fields
    that agree together no more often than by chance then give no matches.
    The table has at most four levels per field, whatever the data's size.
    """
    fields = list(patterns[0][0])
    total = sum(n for _, n in patterns)
    sure = [
        1.0 if any(v != MISSING for v in p.values()) and all(v in (MISSING, AGREE) for v in p.values()) else 0.0
        for p, _ in patterns
    ]
    prior_weight = max(sum(w * n for w, (_, n) in zip(sure, patterns)), 1.0)
    prior = {AGREE: 0.9, PARTIAL: 0.07, DISAGREE: 0.03}

    def levels(weights, base, strength):
        out = {}
        for f in fields:
            mass = {lv: base[lv] * strength for lv in prior}
            for w, (p, n) in zip(weights, patterns):
                if p[f] != MISSING:
                    mass[p[f]] += n * w
            whole = sum(mass.values())
            out[f] = {lv: v / whole for lv, v in mass.items()}
        return out

    def refit(weights):
        share = sum(w * n for w, (_, n) in zip(weights, patterns)) / total
        flat = {lv: 1.0 for lv in prior}
        return LinkModel(
            min(max(share, 1e-12), 1 - 1e-12),
            levels(weights, prior, prior_weight),
            levels([1 - w for w in weights], flat, 1e-3),
        )

    model = refit(sure)
    for _ in range(rounds):
        fresh = refit([model.posterior(p) for p, _ in patterns])
        moved = abs(fresh.match_share - model.match_share)
        model = fresh
        if moved < tol * model.match_share:
            return model
    raise RuntimeError(f"the match share did not settle to {tol} in {rounds} rounds")


def posterior_table(counts: DataFrame, fields: Sequence[str]) -> tuple[LinkModel, DataFrame]:
    """Fit on the pattern table (at most 4 rows per field combination) and score it."""
    rows = counts.collect()
    patterns = [({f: r[f"level_{f}"] for f in fields}, float(r["pairs"])) for r in rows]
    if not patterns:
        raise ValueError("no pairs to fit on")
    model = fit_link_model(patterns)
    scored = [(*[p[f] for f in fields], int(n), float(model.posterior(p))) for p, n in patterns]
    schema = ", ".join(f"level_{f} int" for f in fields) + ", pairs long, posterior double"
    return model, counts.sparkSession.createDataFrame(scored, schema)


def linked_combinations(
    left: DataFrame, right: DataFrame | None, block: Sequence[str], fields: Sequence[str],
    agree: float = 0.94, partial: float = 0.88, threshold: float = 0.85,
) -> DataFrame:
    """Combination pairs whose match probability reaches the threshold."""
    a = combinations(left, block, fields)
    b = None if right is None else combinations(right, block, fields)
    similar = SimilarFields(a, b, block, min(agree, partial))
    _, table = posterior_table(pattern_counts(a, b, block, fields, agree, partial, similar), fields)
    accepted = table.where(F.col("posterior") >= threshold).drop("pairs")
    kept = accepted.collect()  # a subset of the pattern table
    levels = [f"level_{f}" for f in fields]
    found = []
    for i, lead in enumerate(fields):
        # patterns whose first close field is this one; pairs are formed by that field
        here = [
            r for r in kept
            if r[f"level_{lead}"] >= PARTIAL and all(r[f"level_{f}"] < PARTIAL for f in fields[:i])
        ]
        if here:
            pairs = score_fields(_pairs_by(a, b, block, fields, lead, similar.of(lead)), fields)
            table_here = accepted.sparkSession.createDataFrame(here, accepted.schema)
            found.append(add_agreement(pairs, fields, agree, partial).join(table_here, levels))
    if any(all(r[lv] < PARTIAL for lv in levels) for r in kept):
        raise ValueError("the fitted model accepts pairs that agree on nothing")
    if not found:
        # nothing agrees more often than by chance
        pairs = score_fields(_pairs_by(a, b, block, fields, fields[0], similar.of(fields[0])), fields)
        nothing = add_agreement(pairs, fields, agree, partial).withColumn("posterior", F.lit(0.0))
        return nothing.where("posterior > 0")
    return reduce(DataFrame.unionByName, found)


def one_to_one(links: DataFrame, left_id: str, right_id: str, score: str) -> DataFrame:
    """Links that are the best of both their sides; ties by the ids."""
    best_l = first_of_duplicates(links, [left_id], [F.col(score).desc(), F.col(right_id).asc()])
    best_r = first_of_duplicates(links, [right_id], [F.col(score).desc(), F.col(left_id).asc()])
    return best_l.join(best_r.select(left_id, right_id), [left_id, right_id], "left_semi")


def link_tables(
    left: DataFrame, right: DataFrame, left_id: str, right_id: str, block: Sequence[str], fields: Sequence[str],
    agree: float = 0.94, partial: float = 0.88, threshold: float = 0.85, exclusive: bool = True,
) -> DataFrame:
    """All left rows with the id of their match, its probability and a flag.

    ``left`` and ``right`` are representatives, one row per group. Mutual best
    links are kept when ``exclusive``.
    """
    pairs = linked_combinations(left, right, block, fields, agree, partial, threshold)
    rows = expand_null_safe(pairs, left, right, block, fields, left_id, right_id)
    score = reduce(lambda a, b: a + b, [F.coalesce(F.col(f"jw_{f}"), F.lit(0.0)) for f in fields])
    rows = rows.select(left_id, right_id, "posterior", (F.col("posterior") * 1000 + score).alias("_score"))
    if exclusive:
        rows = one_to_one(rows, left_id, right_id, "_score")
    linked = rows.drop("_score")
    return left.join(linked, left_id, "left").withColumn("is_matched", F.col(right_id).isNotNull())


def expand_null_safe(pairs, left, right, block, fields, left_id, right_id) -> DataFrame:
    """Row pairs of combinations whose fields may be missing."""

    def key(prefix, side):
        cells = [*block, *[f"{f}{side}" for f in fields]]
        return F.to_json(F.struct(*[F.col(c).cast("string").alias(f"c{i}") for i, c in enumerate(cells)])).alias(prefix)

    def blank_free(df):
        return df.withColumns({f: F.when(F.length(f) > 0, F.col(f)) for f in fields})

    a = blank_free(left).select(left_id, key("_lk", ""))
    b = blank_free(right).select(right_id, key("_rk", ""))
    keyed = pairs.select("posterior", *[f"jw_{f}" for f in fields], key("_lk", "_l"), key("_rk", "_r"))
    return keyed.join(a, "_lk").join(b, "_rk").drop("_lk", "_rk")


# Groups


def connected_groups(
    nodes: DataFrame, edges: DataFrame, node: str = "node", a: str = "a", b: str = "b", hub_rows: int = HUB_ROWS
) -> DataFrame:
    """(node, group): the group is the smallest node it is linked with.

    Stars are contracted in two ways by turns. First every edge's smaller end gives way
    to that end's smallest neighbour; then a node's smaller neighbours are tied to the
    smallest of them. Both keep what is connected. Ends only get smaller, and a chain of
    n nodes is done in about log n rounds. Each round is written to the checkpoint
    folder; the loop ends when every node has one edge, to a node that is nobody's larger.

    A node with more than ``hub_rows`` edges, and more than a ten-thousandth of all, is a
    hub. Its edges are never brought together: hubs are few, so their smallest
    neighbours go to the tasks in which the edges are.
    """
    one, two = F.col(a), F.col(b)
    pairs = cut_lineage(edges.where(one != two).select(F.greatest(one, two).alias("_large"), F.least(one, two).alias("_small")).distinct())
    while True:
        size = pairs.count()
        if _is_star(pairs):
            break
        pairs = cut_lineage(_small_star(_large_star(pairs, size, hub_rows), size, hub_rows))
    alone = nodes.select(F.col(node).alias("_node")).distinct().join(pairs, F.col("_node") == F.col("_large"), "left")
    return alone.select(F.col("_node").alias(node), F.coalesce("_small", "_node").alias("group"))


def _is_star(pairs: DataFrame) -> bool:
    """If each node is the larger of one pair at most, and not also the smaller of another."""
    roles = pairs.select(F.col("_large").alias("n"), F.lit(1).alias("large"), F.lit(0).alias("small"))
    roles = roles.unionByName(pairs.select(F.col("_small").alias("n"), F.lit(0).alias("large"), F.lit(1).alias("small")))
    sums = roles.groupBy("n").agg(F.sum("large").alias("large"), F.max("small").alias("small"))
    return sums.where((F.col("large") > 1) | (F.col("large") * F.col("small") > 0)).isEmpty()


def _smallest(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy(F.col("_large").alias("_at")).agg(F.min("_small").alias("_least"))


def _large_star(pairs: DataFrame, size: int, hub_rows: int) -> DataFrame:
    """Each pair's larger node with the smallest neighbour of the smaller one, or with that itself."""
    met = _look_up(pairs, "_small", _smallest(pairs), size, hub_rows)
    return met.select("_large", F.coalesce("_least", "_small").alias("_small")).distinct()


def _small_star(pairs: DataFrame, size: int, hub_rows: int) -> DataFrame:
    """A node's smaller neighbours, and the node itself, each with the smallest of them."""
    met = _look_up(pairs, "_large", _smallest(pairs), size, hub_rows)
    others = met.where(F.col("_small") != F.col("_least")).select(F.col("_small").alias("_large"), F.col("_least").alias("_small"))
    own = met.select("_large", F.col("_least").alias("_small"))
    return others.unionByName(own).distinct()


def _look_up(pairs: DataFrame, key: str, table: DataFrame, size: int, hub_rows: int) -> DataFrame:
    """``pairs`` with the ``_least`` of their ``key``, null if it has none; the edges of hubs stay where they are."""

    def plain(df: DataFrame) -> DataFrame:
        return df.join(table, df[key] == table["_at"], "left")

    if size <= hub_rows:
        return plain(pairs)
    at_least = max(hub_rows, size // HUBS)  # so hubs are fewer than HUBS
    hubs = cut_lineage(pairs.groupBy(F.col(key).alias("_hub")).agg(F.count("*").alias("n")).where(F.col("n") > at_least).select("_hub"))
    if hubs.isEmpty():
        return plain(pairs)
    near = hubs.join(table, hubs["_hub"] == table["_at"], "left").select("_hub", "_at", "_least")
    crowded = pairs.join(F.broadcast(near), pairs[key] == near["_hub"]).drop("_hub")
    return crowded.unionByName(plain(pairs.join(F.broadcast(hubs), pairs[key] == hubs["_hub"], "left_anti")))


def dedupe_values(
    df: DataFrame, field: str, block: Sequence[str] = (), cut: float = 0.94, out: str = "group"
) -> DataFrame:
    """Every row with the group of its value: values linked by chains of similar ones.

    A row with a blank value is a group of its own (null group).
    """
    edges = similar_values(df, None, block, field, cut, spanning=True)

    def node(value):
        return F.concat_ws("\u0001", *[F.col(x).cast("string") for x in [*block, value]])

    values = df.where(F.length(field) > 0).select(*block, field).distinct()
    groups = connected_groups(
        values.select(node(field).alias("node")), edges.select(node("left_value").alias("a"), node("right_value").alias("b"))
    )
    groups = groups.select(
        F.col("node").alias("_node"), F.element_at(F.split("group", "\u0001"), -1).alias(out)
    )
    own = F.when(F.length(field) > 0, node(field))
    return df.withColumn("_own", own).join(groups, F.col("_own") == F.col("_node"), "left").drop("_own", "_node")


def dedupe_linked(
    df: DataFrame, fields: Sequence[str], block: Sequence[str] = (),
    agree: float = 0.94, partial: float = 0.88, threshold: float = 0.85, out: str = "group",
) -> DataFrame:
    """Self linkage by the fitted model, then groups of linked combinations."""
    pairs = linked_combinations(df, None, block, fields, agree, partial, threshold)

    def node(side):
        cells = [*block, *[f"{f}{side}" for f in fields]]
        return F.to_json(F.struct(*[F.col(c).cast("string").alias(f"c{i}") for i, c in enumerate(cells)]))

    filled = df.withColumns({f: F.when(F.length(f) > 0, F.col(f)) for f in fields}).withColumn("_own", node(""))
    groups = connected_groups(
        filled.select(F.col("_own").alias("node")).distinct(), pairs.select(node("_l").alias("a"), node("_r").alias("b"))
    )
    groups = groups.select(F.col("node").alias("_node"), F.col("group").alias(out))
    return filled.join(groups, filled["_own"] == groups["_node"], "left").drop("_own", "_node")


def split_groups(df: DataFrame, group: str, state: str, out: str) -> DataFrame:
    return split_groups_by(df, group, state, out)


def expand_matches(
    jobs: DataFrame, cases: DataFrame, links: DataFrame, job_group: str, case_group: str
) -> DataFrame:
    """Every job of a group with every case its group matched.

    Groups without a match keep all their jobs, case columns null. Rows per
    job group: jobs times max(cases, 1). Jobs get their case groups first, so only
    jobs and cases are shuffled, never the pairs of the two.
    """
    known = cases.select(case_group).dropna().distinct()
    matched = links.select(job_group, case_group).dropna().distinct().join(known, case_group, "left_semi")
    wide = join_many(jobs.join(matched, job_group, "left"), cases, [case_group], "left")
    others = [c for c in [*jobs.columns, *cases.columns] if c not in (job_group, case_group)]
    in_order = [job_group, *others[: len(jobs.columns) - 1], case_group, *others[len(jobs.columns) - 1 :]]
    return wide.select(*in_order).withColumn("is_matched", F.col(case_group).isNotNull())


def match_report(before: DataFrame, after: DataFrame, matched: DataFrame, ids: tuple[str, str], flag: str) -> DataFrame:
    """One row: rows and distinct ids before and after deduplication, and the matched share."""
    left = before.agg(F.count("*").alias("rows_before"), F.count_distinct(ids[0]).alias("ids_before"))
    mid = after.agg(F.count("*").alias("rows_after"), F.count_distinct(ids[1]).alias("groups_after"))
    right = matched.agg(
        F.count("*").alias("rows_matched_table"), F.avg(F.col(flag).cast("double")).alias("matched_share")
    )
    return left.crossJoin(mid).crossJoin(right)  # one row each
