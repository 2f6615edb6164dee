"""MLlib jobs: fit, predict, importances, folds, segments, search."""

from __future__ import annotations

import random
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, GeneralizedLinearRegression
from pyspark.sql import DataFrame, functions as F

from shelfline.lineage import stage
from shelfline.operators import metrics
from shelfline.plans.scoring import as_arrays, prefix_errors


def filled(df: DataFrame, columns: Sequence[str], value: float = -1.0) -> DataFrame:
    """Feature columns as doubles, a missing value as ``value``."""
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(value)) for c in columns})


def boosted_trees(
    columns: Sequence[str],
    label: str,
    weight: str | None = None,
    validation: str | None = None,
    categories: Sequence[str] = (),
    levels: int = 256,
    **params,
) -> Pipeline:
    """Boosted regression trees; the declared ``categories`` are split by their levels, all other columns by order.

    Levels are numbered by frequency, unseen ones share a number of their own; a category has
    at most ``levels`` of them. With ``validation`` (a boolean column) boosting stops when the error on those rows stops
    improving.
    """
    tree = GBTRegressor(featuresCol="features", labelCol=label, seed=7, maxBins=max(64, levels if categories else 0), **params)
    if weight:
        tree = tree.setWeightCol(weight)
    if validation:
        tree = tree.setValidationIndicatorCol(validation)
    stages = []
    if categories:
        # The indexer writes the level's number and its kind into the column's metadata, which the trees read.
        numbers = [f"_{c}" for c in categories]
        stages.append(StringIndexer(inputCols=list(categories), outputCols=numbers, handleInvalid="keep"))
    inputs = [f"_{c}" if c in categories else c for c in columns]
    return Pipeline(stages=[*stages, VectorAssembler(inputCols=inputs, outputCol="features"), tree])


def count_regression(
    columns: Sequence[str], label: str, family: str = "tweedie", power: float = 1.1, weight: str | None = None, reg: float = 0.0
) -> Pipeline:
    """Generalised linear model for counts with a log link: ``tweedie`` or ``poisson``."""
    options = {"variancePower": power, "linkPower": 0.0} if family == "tweedie" else {"link": "log"}
    glm = GeneralizedLinearRegression(family=family, labelCol=label, featuresCol="features", maxIter=25, regParam=reg, **options)
    if weight:
        glm = glm.setWeightCol(weight)
    return Pipeline(stages=[VectorAssembler(inputCols=list(columns), outputCol="features"), glm])


def importances(model: PipelineModel, columns: Sequence[str], df: DataFrame) -> DataFrame:
    """(feature, importance), largest first; one row per feature."""
    values = model.stages[-1].featureImportances.toArray()
    rows = [(c, float(v)) for c, v in zip(columns, values)]
    return df.sparkSession.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


def classifier(columns: Sequence[str], label: str, labels_of: DataFrame, **params) -> Pipeline:
    """Random forest over string labels; predictions are decoded back to labels."""
    index = StringIndexer(inputCol=label, outputCol="_label", stringOrderType="alphabetAsc").fit(labels_of)
    return Pipeline(
        stages=[
            index,
            VectorAssembler(inputCols=list(columns), outputCol="features"),
            RandomForestClassifier(labelCol="_label", featuresCol="features", seed=7, **params),
            IndexToString(inputCol="prediction", outputCol="predicted", labels=index.labels),
        ]
    )


def with_class_probabilities(scored: DataFrame, classes: int) -> DataFrame:
    p = vector_to_array("probability")
    return scored.withColumns({f"class_{i}": p[i] for i in range(classes)})


def round_curve(folded: DataFrame, pipeline: Pipeline, columns: Sequence[str], label: str, folds: Sequence[int], threads: int = 3) -> tuple[int, DataFrame]:
    """Best number of boosting rounds, and (rounds, cv_rmse): the mean over the folds of the error of every prefix of the trees.

    One fit per fold gives the errors of all round numbers up to its own; ``folded`` holds each row
    with its test ``fold``.
    """
    folded = stage(folded, "curve-folds", by=["fold"])

    def one(fold: int) -> DataFrame:
        model = pipeline.fit(folded.where(F.col("fold") != fold))
        errors = prefix_errors(folded.where(F.col("fold") == fold), as_arrays(model), columns, label)
        return stage(errors.select("round", F.sqrt(F.col("squares") / F.col("n")).alias("rmse")), "curve")

    with ThreadPoolExecutor(threads) as pool:
        errors = reduce(DataFrame.unionByName, pool.map(one, folds))
    table = errors.groupBy(F.col("round").alias("rounds")).agg(F.avg("rmse").alias("cv_rmse"))
    return table.agg(F.min_by("rounds", F.struct("cv_rmse", "rounds"))).first()[0], table


def fold_ensemble(folded: DataFrame, score: DataFrame, n_folds: int, make: Callable[[], Estimator], by: Sequence[str]) -> tuple[DataFrame, list[PipelineModel]]:
    """Mean prediction of one model per training fold: (*by, prediction)."""
    folded = stage(folded, "ensemble-folds")
    models = [make().fit(folded.filter((F.col("fold") == i) & (F.col("role") == "train"))) for i in range(n_folds)]
    runs = [m.transform(score).select(*by, "prediction") for m in models]
    mean = reduce(DataFrame.unionByName, runs).groupBy(*by).agg(F.avg("prediction").alias("prediction"))
    return mean, models


def mean_importances(models: Sequence[PipelineModel], columns: Sequence[str], df: DataFrame) -> DataFrame:
    tables = [importances(m, columns, df) for m in models]
    return reduce(DataFrame.unionByName, tables).groupBy("feature").agg(F.avg("importance").alias("importance"))


def random_search(
    train: DataFrame,
    test: DataFrame,
    make: Callable[..., Estimator],
    ranges: Mapping[str, tuple[float, float]],
    tries: int,
    label: str,
    metric: metrics.Metric,
    seed: int = 7,
    threads: int = 4,
    at_once: int = 25,
) -> DataFrame:
    """Draw settings uniformly from the ranges and rank them by the metric on ``test``.

    The prepared tables are staged once, before the first try. ``at_once`` fitted models are scored in one pass over
    ``test``. Linear models with squared error may be given ``same_moments`` of their rows as ``train``: then no fit reads the rows.
    """
    rng = random.Random(seed)
    draws = [{n: rng.uniform(*r) for n, r in ranges.items()} for _ in range(tries)]
    train, test = stage(train, "search-train"), stage(test, "search-test")

    def scores(models: Sequence[Model]) -> list[float]:
        scored, names = test, []
        for i, model in enumerate(models):
            scored = model.transform(scored).select(*test.columns, *names, F.col("prediction").alias(f"_prediction_{i}"))
            names.append(f"_prediction_{i}")
        found = scored.agg(*[metric(F.col(label), F.col(n)).alias(n) for n in names]).first()
        return [float(x) for x in found]

    with ThreadPoolExecutor(threads) as pool:
        models = list(pool.map(lambda settings: make(**settings).fit(train), draws))
        found = list(pool.map(scores, [models[i : i + at_once] for i in range(0, tries, at_once)]))
    rows = [(i, *settings.values(), score) for (i, settings), score in zip(enumerate(draws), (x for part in found for x in part))]
    columns = ", ".join(f"{n} double" for n in ranges)
    table = train.sparkSession.createDataFrame(rows, f"iteration int, {columns}, score double")
    return table.orderBy("score", "iteration")


def same_moments(df: DataFrame, columns: Sequence[str], weight: str) -> DataFrame:
    """A few weighted rows with the count, means, variances and covariances of ``columns`` in ``df``, found in one pass.

    A linear model with squared error, penalised or not, depends on nothing else, so it is the same on these rows. Rows
    with a missing value are refused, as an assembler refuses them.
    """
    m = len(columns)
    xs = [F.col(c).cast("double") for c in columns]
    pairs = [(i, j) for i in range(m) for j in range(i, m)]
    missing = reduce(lambda a, b: a | b, [x.isNull() | F.isnan(x) for x in xs])
    found = df.agg(F.count(F.lit(1)), F.count_if(missing), *[F.avg(x) for x in xs], *[F.covar_pop(xs[i], xs[j]) for i, j in pairs]).first()
    n, odd, means = found[0], found[1], np.array(found[2 : 2 + m], float)
    if odd or not n:
        raise ValueError(f"{odd} of {n} rows have a missing value among {list(columns)}")
    both = np.zeros((m, m))
    for (i, j), x in zip(pairs, found[2 + m :]):
        both[i, j] = both[j, i] = x
    deviation = np.sqrt(np.maximum(np.diag(both), 0.0))
    safe = np.where(deviation > 0, deviation, 1.0)
    # Of the correlations, as the columns' sizes may differ by far.
    squares, turn = np.linalg.eigh(both / np.outer(safe, safe))
    steps = (turn * np.sqrt(np.maximum(squares, 0.0) * m)).T * deviation
    rows = [(*map(float, means + sign * step), n / (2 * m)) for step in steps for sign in (1, -1)]
    return df.sparkSession.createDataFrame(rows, ", ".join([*(f"`{c}` double" for c in columns), f"`{weight}` double"]))


def save_and_load(model: PipelineModel, path: str) -> Model:
    model.write().save(path)
    return PipelineModel.load(path)
