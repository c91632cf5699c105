"""Classifiers, their review tables, and the panel regression."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harrow.operators.aggregates import cross_counts
from harrow.session import cut_lineage

DEEPEST = 30  # the library's limit for tree depth


def penalised_logit(penalty: str, c: float, rows: int, **options) -> LogisticRegression:
    """Logit whose penalty weight is 1 / (c * rows), on unscaled features."""
    return LogisticRegression(
        elasticNetParam=1.0 if penalty == "l1" else 0.0, regParam=1.0 / (c * rows), standardization=False, maxIter=200, **options
    )


def estimators(rows: int, seed: int = 0) -> dict[str, object]:
    """The named classifiers of the study; ``rows`` is the size of the training table."""
    # fixed values: names that result rows carry, and their settings
    return {
        "dt_shallow": DecisionTreeClassifier(maxDepth=5, seed=seed),
        "dt_deep": DecisionTreeClassifier(maxDepth=DEEPEST, seed=seed),
        "random_forest_10020": RandomForestClassifier(numTrees=100, maxDepth=20, seed=seed),
        "random_forest_100020": RandomForestClassifier(numTrees=1000, maxDepth=20, seed=seed),
        "gb_shallow": GBTClassifier(maxIter=100, maxDepth=3, seed=seed),
        "gb_deep": GBTClassifier(maxIter=200, maxDepth=3, seed=seed),
        "ada": AdaBoost(rounds=50),
        "logit_l1_lowerpen": penalised_logit("l1", 0.01, rows),
        "logit_l2_lowerpen": penalised_logit("l2", 0.01, rows),
    }


def cross_validated_logit(train: DataFrame, rows: int, penalties: Sequence[float] = (0.01, 0.1, 1.0, 10.0), folds: int = 5):
    """L2 logit whose penalty is chosen by cross-validation."""
    base = LogisticRegression(standardization=False, maxIter=200)
    grid = ParamGridBuilder().addGrid(base.regParam, [1.0 / (c * rows) for c in penalties]).build()
    judge = BinaryClassificationEvaluator()
    return CrossValidator(estimator=base, estimatorParamMaps=grid, evaluator=judge, numFolds=folds, seed=1, parallelism=4).fit(train)


@dataclass
class AdaBoostModel:
    """Weighted vote of depth-one trees."""

    trees: list
    votes: list[float]

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds ``prediction`` and ``probability_true``, the weighted share of positive votes."""
        total = F.lit(0.0)
        current = df
        for i, (tree, vote) in enumerate(zip(self.trees, self.votes)):
            tree.setPredictionCol(f"_p{i}").setRawPredictionCol("").setProbabilityCol("")
            current = tree.transform(current)
            total = total + F.col(f"_p{i}") * vote
        share = total / F.lit(sum(self.votes))
        current = current.withColumn("probability_true", share).drop(*[f"_p{i}" for i in range(len(self.trees))])
        return current.withColumn("prediction", (F.col("probability_true") > 0.5).cast("double"))

    def importances(self):
        parts = [v * t.featureImportances.toArray() for t, v in zip(self.trees, self.votes)]
        return sum(parts) / sum(self.votes)


class AdaBoost:
    """Boosted depth-one trees: rows missed by a round weigh more in the next."""

    def __init__(self, rounds: int = 50, keep_every: int = 10):
        self.rounds, self.keep_every = rounds, keep_every

    def fit(self, df: DataFrame) -> AdaBoostModel:
        current = cut_lineage(df.select("features", "label", F.lit(1.0).alias("_w")))
        trees, votes = [], []
        for i in range(self.rounds):
            tree = DecisionTreeClassifier(maxDepth=1, weightCol="_w", seed=i).fit(current)
            missed = (F.col("prediction") != F.col("label")).cast("double")
            scored = tree.transform(current).select("features", "label", "_w", missed.alias("_missed"))
            sums = scored.agg(F.sum("_w").alias("w"), F.sum(F.col("_w") * F.col("_missed")).alias("e")).first()
            error = sums["e"] / sums["w"]
            if error >= 0.5:
                break
            vote = math.log((1 - error) / max(error, 1e-10))
            trees.append(tree)
            votes.append(vote)
            if error == 0:
                break
            before = current
            scale = F.lit(1.0 / sums["w"])
            current = scored.select(
                "features", "label", (F.col("_w") * scale * F.exp(F.col("_missed") * vote)).alias("_w")
            )
            current = cut_lineage(current) if (i + 1) % self.keep_every == 0 else current.persist()
            current.count()
            before.unpersist()
        if not trees:
            raise ValueError("no tree does better than chance")
        return AdaBoostModel(trees, votes)


def predictions(model, name: str, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Long prediction rows: predicted, actual, both probabilities, model."""
    scored = model.transform(df)
    if "probability_true" not in scored.columns:
        scored = scored.withColumn("probability_true", vector_to_array("probability")[1])
    return scored.select(
        *keep,
        F.col("prediction").cast("int").alias("predicted"),
        F.col("label").cast("int").alias("actual"),
        (1 - F.col("probability_true")).alias("predicted_cont_false"),
        F.col("probability_true").alias("predicted_cont_true"),
        F.lit(name).alias("model"),
    )


def scores(predicted: DataFrame, keys: Sequence[str] = ("model",)) -> DataFrame:
    """accuracy, precision, recall and f1 per model in one pass; undefined is 0."""
    hit = (F.col("predicted") == 1) & (F.col("actual") == 1)
    counted = predicted.groupBy(*keys).agg(
        F.count("*").alias("_n"),
        F.count_if(F.col("predicted") == F.col("actual")).alias("_right"),
        F.count_if(hit).alias("_tp"),
        F.count_if(F.col("predicted") == 1).alias("_pp"),
        F.count_if(F.col("actual") == 1).alias("_ap"),
    )

    def share(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))

    return counted.select(
        *keys,
        share(F.col("_right"), F.col("_n")).alias("accuracy"),
        share(F.col("_tp"), F.col("_pp")).alias("precision"),
        share(F.col("_tp"), F.col("_ap")).alias("recall"),
        share(2 * F.col("_tp"), F.col("_pp") + F.col("_ap")).alias("f1"),
    )


def importances(model, name: str, features: Sequence[str], like: DataFrame) -> DataFrame:
    """(value, coef_name, model) for every feature; bounded by the feature list."""
    if hasattr(model, "coefficients"):
        values = model.coefficients.toArray()
    elif isinstance(model, AdaBoostModel):
        values = model.importances()
    else:
        values = model.featureImportances.toArray()
    rows = [(float(v), f, name) for v, f in zip(values, features)]
    return like.sparkSession.createDataFrame(rows, "value double, coef_name string, model string")


def estimate(
    models: Mapping[str, object], train: DataFrame, test: DataFrame, features: Sequence[str] = (), keep: Sequence[str] = ()
) -> dict[str, DataFrame]:
    """Fit every named estimator and stack the review tables.

    ``train`` and ``test`` have ``features`` and ``label``. Result: predictions,
    evals, confusion and, when feature names are given, importances.
    """
    # kept while the estimators read them, unless the caller keeps them anyway
    lent = [df.persist() for df in (train, test) if not df.is_cached]
    fitted = {name: estimator.fit(train) for name, estimator in models.items()}
    predicted = reduce(
        DataFrame.unionByName, [predictions(m, name, test, keep) for name, m in fitted.items()]
    )
    predicted = cut_lineage(predicted)
    as_flags = predicted.withColumns({"predicted": F.col("predicted") == 1, "actual": F.col("actual") == 1})
    out = {
        "predictions": predicted,
        "evals": scores(predicted),
        "confusion": cross_counts(as_flags, "actual", "predicted", ["model"]),
    }
    if features:
        out["importances"] = reduce(
            DataFrame.unionByName, [importances(m, n, features, test) for n, m in fitted.items()]
        )
    for df in lent:
        df.unpersist()
    return out


def nonzero_counts(table: DataFrame) -> DataFrame:
    return table.groupBy("model").agg(F.count_if(F.col("value") != 0).alias("nonzero"), F.count("*").alias("features"))


def paired_logits(df: DataFrame, features: Sequence[str], labels: tuple[str, str], penalty: float = 0.01) -> DataFrame:
    """Two unpenalised logits on the same features, coefficients in long form.

    The features are those to which an L1-penalised logit of either label gives a
    weight; all of them if it gives none.
    """
    kept: set[int] = set()
    for label in labels:
        lasso = LogisticRegression(labelCol=label, regParam=penalty, elasticNetParam=1.0, maxIter=200).fit(df)
        kept |= {i for i, v in enumerate(lasso.coefficients.toArray()) if v}
    places = sorted(kept) or list(range(len(features)))
    sliced = VectorSlicer(inputCol="features", outputCol="_kept", indices=places).transform(df)
    sliced = sliced.drop("features").withColumnRenamed("_kept", "features")
    parts = []
    for label in labels:
        model = LogisticRegression(labelCol=label, regParam=0.0, maxIter=200).fit(sliced)
        parts.append(importances(model, label, [features[i] for i in places], df))
    return parts[0].unionByName(parts[1])


def average_by_name(table: DataFrame, prefix: str, most: int = 20, few: int = 10) -> DataFrame:
    """Mean coefficient over names that differ by case only; the largest positive
    ones with and without a name prefix."""
    from harrow.operators.groups import top_per_group

    means = table.groupBy(F.upper("coef_name").alias("coef_name_upper")).agg(F.avg("value").alias("value"))
    marked = means.where("value > 0").withColumn("has_prefix", F.col("coef_name_upper").startswith(prefix.upper()))
    ranked = top_per_group(marked, ["has_prefix"], [F.col("value").desc(), F.col("coef_name_upper").asc()], most)
    return ranked.where(~F.col("has_prefix") | (F.col("place") <= few))


def score_histogram(predicted: DataFrame, bins: int = 20, score: str = "predicted_cont_true") -> DataFrame:
    """Share of each actual class per score bin, per model."""
    bin_ = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1))
    counts = predicted.groupBy("model", "actual", bin_.alias("bin")).agg(F.count("*").alias("n"))
    totals = counts.groupBy(F.col("model").alias("_m"), F.col("actual").alias("_a")).agg(F.sum("n").alias("_n"))
    joined = counts.join(totals, (F.col("model") == F.col("_m")) & (F.col("actual") == F.col("_a")))
    return joined.select("model", "actual", "bin", "n", (F.col("n") / F.col("_n") * bins).alias("density"))


def _binned(df: DataFrame, x: str, y: str, bins: int) -> DataFrame:
    """(bin, x, y): the known pairs in bins of ``x`` with equal numbers of rows, the first ones a row larger; ties go by ``y``."""
    from harrow.operators.order import row_positions

    known = df.select(x, y).where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = row_positions(known, [F.col(x).asc(), F.col(y).asc()], out="_place")
    placed = ranked.crossJoin(known.agg(F.count("*").alias("_n")))  # one row
    at, least, more = F.col("_place") - 1, F.floor(F.col("_n") / bins), F.col("_n") % bins
    wide = more * (least + 1)  # rows in the larger bins
    place = F.when(at < wide, F.floor(at / (least + 1))).otherwise(more + F.floor(F.try_divide(at - wide, least)))
    return placed.select(place.alias("bin"), F.col(x).alias("x"), F.col(y).alias("y"))


def binned_trend(df: DataFrame, x: str, y: str, bins: int = 10, digits: int = 4) -> DataFrame:
    """Mean of ``y`` and ``x`` in bins of ``x`` with equal numbers of rows, the first ones a row larger; ties go by ``y``.

    Sums are taken of decimals with ``digits`` places and divided once, so the means do
    not depend on the order in which rows are added.
    """
    sums = _binned(df, x, y, bins).groupBy("bin").agg(*_moments(digits, "x", "y"), F.count("*").alias("n"))
    return sums.select("bin", *[(F.col(f"sum_{c}").cast("double") / F.col("n")).alias(f"mean_{c}") for c in "xy"], "n")


def _moments(digits: int, *products: str) -> list[Column]:
    """Exact sums of products of columns with one-letter names, ``xy`` as ``sum_xy``."""
    out = []
    for letters in products:
        value = reduce(lambda a, b: a * b, [F.col(c).cast(f"decimal(18,{digits})") for c in letters])
        out.append(F.sum(value).alias(f"sum_{letters}"))
    return out


def smoothed_trend(df: DataFrame, x: str, y: str, bins: int = 20, span: float = 0.4, digits: int = 4) -> DataFrame:
    """(bin, center, smooth, n): a local straight line through the rows near each bin's mean, read off there.

    Rows are reduced to the exact moments of equal-count bins. Of these the nearest
    ones that hold ``span`` of the bins take part in a fit, with tricube weights of the distance of
    their means; the weighted moments give the line. A neighbourhood without spread in
    ``x`` has the weighted mean. Only the bins' table, of ``bins`` rows, meets itself.
    """
    sums = _binned(df, x, y, bins).groupBy("bin").agg(*_moments(digits, "x", "y", "xx", "xy"), F.count("*").alias("n"))
    double = [F.col(c).cast("double").alias(c) for c in ("sum_x", "sum_y", "sum_xx", "sum_xy")]
    table = sums.select("bin", *double, "n", (F.col("sum_x").cast("double") / F.col("n")).alias("at"))
    around = table.select(F.col("bin").alias("_bin"), F.col("at").alias("_at"))
    pairs = around.crossJoin(table).withColumn("_far", F.abs(F.col("at") - F.col("_at")))  # bins times bins rows
    near = Window.partitionBy("_bin").orderBy("_far", "bin")
    many = max(2, math.ceil(span * bins))
    pairs = pairs.withColumn("_place", F.row_number().over(near)).withColumn("_reach", F.max(F.when(F.col("_place") <= many, F.col("_far"))).over(Window.partitionBy("_bin")))
    share = F.when(F.col("_reach") > 0, F.col("_far") / (F.col("_reach") * 1.000001)).otherwise(0.0)
    weighed = pairs.where(F.col("_place") <= many).withColumn("_w", F.pow(1 - F.pow(share, 3), 3))
    # moments about the place itself, so that large values do not cancel
    dx, dxx, dxy = (
        F.col("sum_x") - F.col("n") * F.col("_at"),
        F.col("sum_xx") - 2 * F.col("_at") * F.col("sum_x") + F.col("n") * F.col("_at") * F.col("_at"),
        F.col("sum_xy") - F.col("_at") * F.col("sum_y"),
    )
    terms = {"s": F.col("n"), "sx": dx, "sy": F.col("sum_y"), "sxx": dxx, "sxy": dxy}
    fit = weighed.groupBy("_bin", "_at").agg(
        *[F.sum(F.col("_w") * v).alias(k) for k, v in terms.items()], F.max(F.when(F.col("bin") == F.col("_bin"), F.col("n"))).alias("n")
    )
    spread = F.col("s") * F.col("sxx") - F.col("sx") * F.col("sx")
    flat = spread <= 1e-9 * F.col("s") * F.col("sxx")
    line = F.when(flat, F.col("sy") / F.col("s")).otherwise((F.col("sxx") * F.col("sy") - F.col("sx") * F.col("sxy")) / spread)
    return fit.select(F.col("_bin").alias("bin"), F.col("_at").alias("center"), line.alias("smooth"), "n")


def two_way_effects(df: DataFrame, unit: str, period: str, x: str, y: str, tol: float = 1e-12, rounds: int = 200) -> DataFrame:
    """Slope and standard error of ``y`` on ``x`` with unit and period effects. One row: slope, std_error, n.

    Rows are reduced once to the count, means and inner moments of each cell of unit and
    period. With the unit effects eliminated, those of the periods solve a linear system,
    here by conjugate gradients for both variables at once. A product with its matrix
    takes the cells to units and back, so neither the matrix nor a vector leaves
    the tasks; a few sums a round do. A balanced panel takes one round, any panel at most one
    for each period but for rounding. Panels of several unconnected parts are solved all the same.
    """
    known = df.select(F.col(unit).alias("u"), F.col(period).alias("p"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna()
    n = F.count("*")
    cells = known.groupBy("u", "p").agg(
        n.cast("double").alias("n"), F.avg("x").alias("x"), F.avg("y").alias("y"),
        (F.var_pop("x") * n).alias("xx"), (F.covar_pop("x", "y") * n).alias("xy"), (F.var_pop("y") * n).alias("yy"),
    )
    cells = cut_lineage(cells)
    both = ("x", "y")

    def unit_means(table: DataFrame, names: Sequence[str]) -> DataFrame:
        weighed = [(F.sum(F.col("n") * F.col(c)) / F.sum("n")).alias(f"u{c}") for c in names]
        return table.groupBy(F.col("u").alias("_u")).agg(*weighed)

    def met(table: DataFrame, other: DataFrame, key: str) -> DataFrame:
        return table.join(other, table[key] == other[f"_{key}"]).drop(f"_{key}")

    means = unit_means(cells, both)
    # what a period's cells are above their units' means
    left = [F.sum(F.col("n") * (F.col(c) - F.col(f"u{c}"))).alias(f"r{c}") for c in both]
    state = met(cells, means, "u").groupBy("p").agg(F.sum("n").alias("size"), *left)
    state = cut_lineage(state.select("*", *[v for c in both for v in (F.lit(0.0).alias(f"b{c}"), (F.col(f"r{c}") / F.col("size")).alias(f"d{c}"))]))

    def sums(table: DataFrame, a: str, b: str, share: bool) -> dict[str, float]:
        part = F.col("size") if share else F.lit(1.0)
        row = table.agg(*[F.sum(F.col(a + c) * F.col(b + c) / part).alias(c) for c in both]).first()
        return {c: row[c] or 0.0 for c in both}

    first = current = sums(state, "r", "r", True)
    for _ in range(rounds):
        if all(current[c] <= tol**2 * first[c] for c in both):
            break
        carried = state.select(F.col("p").alias("_p"), *[F.col(f"d{c}") for c in both])
        through = unit_means(met(cells, carried, "p"), [f"d{c}" for c in both])
        back = met(cells, through, "u").groupBy(F.col("p").alias("_p")).agg(*[F.sum(F.col("n") * F.col(f"ud{c}")).alias(f"q{c}") for c in both])
        state = met(state, back, "p")
        state = cut_lineage(state.withColumns({f"q{c}": F.col("size") * F.col(f"d{c}") - F.col(f"q{c}") for c in both}))
        bend = sums(state, "d", "q", False)
        step = {c: current[c] / bend[c] if bend[c] > 0 and current[c] > tol**2 * first[c] else 0.0 for c in both}
        state = state.withColumns(
            {f"b{c}": F.col(f"b{c}") + step[c] * F.col(f"d{c}") for c in both} | {f"r{c}": F.col(f"r{c}") - step[c] * F.col(f"q{c}") for c in both}
        )
        after = sums(state, "r", "r", True)
        turn = {c: after[c] / current[c] if step[c] else 0.0 for c in both}
        state = state.withColumns({f"d{c}": F.col(f"r{c}") / F.col("size") + turn[c] * F.col(f"d{c}") for c in both}).drop("qx", "qy")
        current = {c: after[c] if step[c] else 0.0 for c in both}
    else:
        raise RuntimeError(f"the effects did not settle to {tol} in {rounds} rounds")
    effects = state.select(F.col("p").alias("_p"), "bx", "by")
    cleared = met(cells, effects, "p").withColumns({c: F.col(c) - F.col(f"b{c}") for c in both})
    rest = met(cleared, unit_means(cleared, both), "u").withColumns({c: F.col(c) - F.col(f"u{c}") for c in both})
    total = rest.agg(
        F.sum("n").cast("long").alias("n"), F.count_distinct("u").alias("u"), F.count_distinct("p").alias("p"),
        *[F.sum(F.col(a + b) + F.col("n") * F.col(a) * F.col(b)).alias(a + b) for a, b in ("xx", "xy", "yy")],
    )
    slope = F.col("xy") / F.col("xx")
    freedom = F.col("n") - F.col("u") - F.col("p")
    remains = F.col("yy") - slope * F.col("xy")
    return total.select(slope.alias("slope"), F.sqrt(remains / freedom / F.col("xx")).alias("std_error"), "n")
