"""Candidate models, nested tuning, bake-offs, refits and their explanations."""

import json
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import reduce
from itertools import product

from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.operators.metrics import metrics, weighted_metrics
from ledgerline.operators.preprocess import FeatureSet, Prepared, cast_inputs, fit_preparations
from ledgerline.operators.splits import primary_folds
from ledgerline.settings import FOLDS, INNER_FOLDS, INNER_OFFSETS, OUTER_CUTOFFS, REPEATS, SEED
from ledgerline.sources.writers import written

SCALED = {"Linear Regression", "Ridge", "Lasso", "Elastic Net"}
Params = dict[str, float | int | bool]


@dataclass(frozen=True)
class Candidate:
    """An estimator builder and the grid tried for it."""

    build: Callable[[Params, "Scale"], object]
    grid: dict[str, list]

    def settings(self) -> list[Params]:
        return [dict(zip(self.grid, values, strict=True)) for values in product(*self.grid.values())]


@dataclass(frozen=True)
class Scale:
    """Facts of the training label that turn a ridge penalty into Spark's scale."""

    weight: float
    deviation: float  # weighted, as the solver scales the label
    most_categories: int = 0  # of a field that is given as an index


COMMON = {"featuresCol": "features", "labelCol": "label", "predictionCol": "log_prediction", "weightCol": "fit_weight"}


def _linear(alpha: float, ratio: float, intercept: bool = True) -> LinearRegression:
    return LinearRegression(
        **COMMON, regParam=alpha, elasticNetParam=ratio, fitIntercept=intercept, standardization=False, maxIter=200
    )


def _mixed_penalty(alpha: float, ratio: float, deviation: float) -> LinearRegression:
    """The solver scales the label by its deviation, which shrinks its squared penalty but not the absolute one."""
    strength = alpha * ratio + alpha * (1 - ratio) * deviation
    return _linear(strength, alpha * ratio / strength)


def _forest(p: Params, bootstrap: bool) -> RandomForestRegressor:
    return RandomForestRegressor(
        **COMMON,
        numTrees=p["trees"],
        maxDepth=p["depth"],
        minInstancesPerNode=p.get("leaf", 1),
        bootstrap=bootstrap,
        seed=SEED,
    )


# Depth 30 is Spark's deepest tree and stands for an unlimited one.
MODELS: dict[str, Candidate] = {
    "Linear Regression": Candidate(lambda p, s: _linear(0.0, 0.0, p["intercept"]), {"intercept": [True, False]}),
    "Ridge": Candidate(
        lambda p, s: _linear(p["alpha"] * s.deviation / s.weight, 0.0), {"alpha": [0.1, 1.0, 10.0, 100.0]}
    ),
    "Lasso": Candidate(lambda p, s: _linear(p["alpha"], 1.0), {"alpha": [0.01, 0.1, 1.0, 10.0]}),
    "Elastic Net": Candidate(
        lambda p, s: _mixed_penalty(p["alpha"], p["ratio"], s.deviation), {"alpha": [0.01, 0.1, 1.0], "ratio": [0.2, 0.5, 0.8]}
    ),
    "Random Forest": Candidate(
        lambda p, s: _forest(p, True), {"trees": [200, 400], "depth": [30, 8], "leaf": [1, 3]}
    ),
    # No random thresholds in Spark: whole sample per tree, features sampled per split.
    "Extra Trees": Candidate(
        lambda p, s: _forest(p, False), {"trees": [200, 400], "depth": [30, 8], "leaf": [1, 3]}
    ),
    "Gradient Boosting": Candidate(
        lambda p, s: GBTRegressor(**COMMON, maxIter=p["rounds"], stepSize=p["rate"], maxDepth=p["depth"], seed=SEED),
        {"rounds": [100, 200], "rate": [0.05, 0.1], "depth": [2, 3]},
    ),
}


#: Learners that take category indices instead of one column a category.
NATIVE = {"Categorical Boosting"}
MODELS["Categorical Boosting"] = Candidate(
    lambda p, s: GBTRegressor(
        **COMMON, maxIter=p["rounds"], stepSize=p["rate"], maxDepth=p["depth"], maxBins=s.most_categories + 32, seed=SEED
    ),
    {"rounds": [100, 200], "rate": [0.05, 0.1], "depth": [4, 6]},
)

#: Tree candidates with their whole grids.
TREES = {name: candidate for name, candidate in MODELS.items() if name not in SCALED}


def with_grid(names: dict[str, dict[str, list]]) -> dict[str, Candidate]:
    """The named candidates with other grids."""
    return {name: Candidate(MODELS[name].build, grid) for name, grid in names.items()}


# --- fitting -----------------------------------------------------------------------


def labelled(df: DataFrame, target: str, weight: str | None) -> DataFrame:
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    return df.withColumn("label", F.log1p(F.col(target).cast("double"))).withColumn("fit_weight", w)


def label_scale(rows: DataFrame) -> Scale:
    deviation = Summarizer.std(array_to_vector(F.array("label")), F.col("fit_weight"))
    facts = rows.agg(F.sum("fit_weight").alias("w"), deviation.alias("d")).first()
    return Scale(facts["w"] or 1.0, float(facts["d"][0]) or 1.0)


def undo_log() -> SQLTransformer:
    return SQLTransformer(statement="select *, expm1(log_prediction) as predicted from __THIS__")


def stages_of(prepared: Prepared, name: str) -> list:
    return prepared.index_stages() if name in NATIVE else prepared.stages(name in SCALED)


def assembled(df: DataFrame, stages: list, target: str, weight: str | None) -> DataFrame:
    """What a learner sees of the rows, kept for the several settings that read it; unpersist when done."""
    rows = labelled(df, target, weight)
    for stage in stages:
        rows = stage.transform(rows)
    return rows.select("features", "label", "fit_weight", F.col(target).cast("double").alias(target)).persist()


def learner(rows: DataFrame, prepared: Prepared, candidate: Candidate, params: Params):
    """The candidate of one setting, fitted on assembled rows."""
    categories = max((len(i.labels) for i in prepared.indexers.values()), default=0)
    return candidate.build(params, replace(label_scale(rows), most_categories=categories)).fit(rows)


def fit_one(
    train: DataFrame, prepared: Prepared, name: str, candidate: Candidate, params: Params, target: str, weight: str | None
) -> PipelineModel:
    """Fit on log1p of the target; the pipeline ends by undoing the log."""
    stages = stages_of(prepared, name)
    rows = assembled(train, stages, target, weight)
    try:
        fitted = learner(rows, prepared, candidate, params)
    finally:
        rows.unpersist()
    return PipelineModel([*stages, fitted, undo_log()])


def mean_absolute_error(scored: DataFrame, target: str) -> float:
    value = scored.agg(F.avg(F.abs(F.col(target) - F.col("predicted"))).alias("mae")).first()["mae"]
    return math.inf if value is None else value


def tune(
    name: str, candidate: Candidate, inner: list[tuple[DataFrame, DataFrame, Prepared]], target: str, weight: str | None
) -> Params:
    """Setting with the lowest unweighted error in money over the inner folds."""
    settings = candidate.settings()
    if len(settings) == 1 or not inner:
        return settings[0]
    errors = [0.0] * len(settings)
    for a, b, prepared in inner:
        stages = stages_of(prepared, name)
        train, test = (assembled(part, stages, target, weight) for part in (a, b))
        for i, params in enumerate(settings):
            scored = undo_log().transform(learner(train, prepared, candidate, params).transform(test))
            errors[i] += mean_absolute_error(scored, target)
        train.unpersist()
        test.unpersist()
    return settings[errors.index(min(errors))]


# --- splits ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Split:
    labels: dict[str, int]
    train: DataFrame
    test: DataFrame
    inner: Callable[[], list[tuple[DataFrame, DataFrame]]]


def inner_groups(train: DataFrame, k: int, salt: int = 0) -> list[tuple[DataFrame, DataFrame]]:
    """Inner folds by company hash: no shuffle, no company on both sides."""
    fold = F.pmod(F.xxhash64(F.col("company_id"), F.lit(SEED + salt)), F.lit(k))
    return [(train.filter(fold != i), train.filter(fold == i)) for i in range(k)]


def grouped_splits(df: DataFrame, k: int = FOLDS, repeats: int = REPEATS, inner: int = INNER_FOLDS) -> Iterator[Split]:
    """Outer folds over space companies; added populations only ever train."""
    folded = written(primary_folds(df, k, repeats), "folds")
    for repeat in range(repeats):
        rows = folded.filter(F.col("repeat") == repeat)
        for fold in range(k):
            train = rows.filter(F.col("fold").isNull() | (F.col("fold") != fold))
            test = rows.filter(F.col("fold") == fold)
            yield Split(
                {"repeat": repeat, "fold": fold},
                train,
                test,
                lambda train=train, salt=repeat * k + fold: inner_groups(train, inner, salt),
            )


def inner_years(train: DataFrame, cutoff: int, offsets: list[int]) -> list[tuple[DataFrame, DataFrame]]:
    year = F.col("target_year")
    pairs = [
        (train.filter(year <= cutoff - o), train.filter((year > cutoff - o) & (year <= cutoff))) for o in offsets
    ]
    return [(a, b) for a, b in pairs if not a.isEmpty() and not b.isEmpty()]


def temporal_splits(
    df: DataFrame, cutoffs: list[int] = OUTER_CUTOFFS, offsets: list[int] = INNER_OFFSETS
) -> Iterator[Split]:
    year = F.col("target_year")
    for cutoff in cutoffs:
        train, test = df.filter(year <= cutoff), df.filter(year > cutoff)
        if train.isEmpty() or test.isEmpty():
            continue
        yield Split(
            {"cutoff_year": cutoff}, train, test, lambda train=train, c=cutoff: inner_years(train, c, offsets)
        )


# --- bake-off -----------------------------------------------------------------------------


def out_of_fold(
    splits: Iterator[Split],
    models: dict[str, Candidate],
    features: FeatureSet,
    target: str,
    weight: str | None,
    keep: list[str],
) -> DataFrame:
    """Held-out predictions of every model and split, with the tuned setting, stored: metrics read them several times.

    The loops run over models and folds, never over data; preparation is fitted for
    all splits together and shared by their models."""
    stored: list[DataFrame] = []
    tuned = any(len(c.settings()) > 1 for c in models.values())
    cuts = [(split, split.inner() if tuned else []) for split in splits]
    if not cuts:
        raise ValueError("no split has both training and test rows")
    trains = [t for split, inner in cuts for t in (split.train, *(a for a, _ in inner))]
    fitted = iter(fit_preparations(trains, features, any(m in SCALED for m in models)))
    for split, pairs in cuts:
        prepared = next(fitted)
        inner = [(a, b, next(fitted)) for a, b in pairs]
        companies = split.train.agg(F.count_distinct("company_id")).first()[0]
        scored: list[DataFrame] = []
        for name, candidate in models.items():
            params = tune(name, candidate, inner, target, weight)
            model = fit_one(split.train, prepared, name, candidate, params, target, weight)
            labels = {**split.labels, "n_train_companies": companies}
            columns = [F.lit(v).alias(k) for k, v in labels.items()]
            scored.append(
                model.transform(split.test).select(
                    *keep,
                    *columns,
                    F.lit(name).alias("Model"),
                    F.lit(json.dumps(params)).alias("best_params"),
                    F.col(target).cast("double").alias("actual"),
                    "predicted",
                    (F.lit(1.0) if weight is None else F.col(weight)).alias("weight"),
                )
            )
        stored.append(written(reduce(DataFrame.unionByName, scored), "held-out"))  # the models of one split at a time
    return reduce(DataFrame.unionByName, stored)


def by_mission(rows: DataFrame, missions: list[str], evaluate: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """`evaluate` on each mission's own rows: no mission trains or tunes another one's models."""
    return reduce(DataFrame.unionByName, [evaluate(rows.filter(F.col("mission") == m)) for m in missions])


def last_target_year(rows: DataFrame) -> int | None:
    return rows.agg(F.max("target_year")).first()[0]


def fold_metrics(predictions: DataFrame, keys: list[str], weighted: bool = True) -> DataFrame:
    groups = [*keys, "Model"]
    scores = (
        weighted_metrics(predictions, groups, "actual", "predicted", "weight")
        if weighted
        else metrics(predictions, groups, "actual", "predicted")
    )
    facts = predictions.groupBy(*groups).agg(
        F.count_distinct("company_id").alias("n_test_companies"),
        F.max("n_train_companies").alias("n_train_companies"),
        F.max("best_params").alias("best_params"),
    )
    return scores.join(facts, groups)


def mean_held_out(predictions: DataFrame, keys: list[str]) -> DataFrame:
    """Mean held-out prediction and number of test folds per row."""
    return predictions.groupBy(*keys).agg(
        F.avg("predicted").alias("predicted_total_turnover_oof"),
        F.count("*").alias("n_test_folds"),
        F.first("actual").alias("actual_total_turnover"),
    )


def fit_final(
    df: DataFrame,
    name: str,
    candidate: Candidate,
    features: FeatureSet,
    target: str,
    weight: str | None,
    inner: list[tuple[DataFrame, DataFrame]],
) -> tuple[PipelineModel, Params, Prepared]:
    """Tune on all rows and refit."""
    several = len(candidate.settings()) > 1
    inner = inner if several else []
    prepared, *others = fit_preparations([df, *(a for a, _ in inner)], features)
    params = tune(name, candidate, [(a, b, p) for (a, b), p in zip(inner, others, strict=True)], target, weight)
    return fit_one(df, prepared, name, candidate, params, target, weight), params, prepared


def feature_weights(model: PipelineModel, prepared: Prepared, mission: str, like: DataFrame) -> DataFrame:
    """Coefficients with their direction, or importances; one row per feature."""
    fitted = model.stages[-2]
    linear = hasattr(fitted, "coefficients")
    values = (fitted.coefficients if linear else fitted.featureImportances).toArray()
    names = prepared.names if len(prepared.names) == len(values) else prepared.index_names
    rows = [(mission, n, float(v)) for n, v in zip(names, values, strict=True)]
    table = like.sparkSession.createDataFrame(rows, "mission string, feature string, weight double")
    weight = F.col("weight")
    sign = F.when(weight > 0, "positive").when(weight < 0, "negative").otherwise("zero")
    return table.withColumn("metric_type", F.lit("coefficient" if linear else "importance")).withColumn(
        "direction", sign if linear else F.lit(None).cast("string")
    )


def prepared_rows(df: DataFrame, features: FeatureSet) -> DataFrame:
    return cast_inputs(df, features)


def scored_by_mission(models: dict[str, PipelineModel], df: DataFrame, route: Column, keep: list[str]) -> DataFrame:
    """Score each row with the model of its route."""
    parts = [model.transform(df.filter(route == key)).select(*keep, "predicted") for key, model in models.items()]
    return reduce(DataFrame.unionByName, parts)
