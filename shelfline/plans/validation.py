"""Cross-validation over random, stratified, time and feature folds, with metrics of predictions and of probabilities.

A folded table has the columns ``mc_seed`` and ``fold``. With a ``role`` column a row is a training
or a test row of its fold; without one it is the test row of its fold and a training row of all
other folds of its seed. The table is written once with a folder per (seed, fold, role), and every
job reads only the folders of its rows: a fit never scans another fold's test rows, and scoring a fold
scans that fold alone.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark.ml import Estimator, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from shelfline.lineage import stage
from shelfline.operators import folds
from shelfline.operators.running import running_total_by

#: Fold number of the rows that hold the score of a whole seed.
WHOLE = -1


def split(
    df: DataFrame,
    split_type: str,
    key: str,
    n_folds: int = 5,
    seeds: Sequence[int] = (0,),
    stratified: bool = False,
    label: str | None = None,
    feature: str | None = None,
    order: Sequence[str] = (),
    train_window: int | None = None,
    test_window: int | None = None,
) -> DataFrame:
    """The folded table of a split type.

    * ``random``: ``n_folds`` folds per seed, dealt within each label if ``stratified``
    * ``feature``: ``n_folds`` folds that never split a value of ``feature``
    * ``time``: rolling windows of ``train_window`` and ``test_window`` rows along ``order``, with roles
    """
    folds.check_cv_arguments(split_type, stratified, n_folds, train_window, test_window)
    if split_type == "time":
        return folds.rolling_row_folds(df, order, train_window, test_window).withColumn("mc_seed", F.lit(0))
    if split_type == "feature":
        return folds.group_folds(df, feature, n_folds).withColumn("mc_seed", F.lit(0))
    if not stratified:
        return folds.random_folds(df, key, n_folds, seeds)
    dealt = []
    for i, seed in enumerate(seeds):
        one = folds.stratified_folds(df, key, label, n_folds, seed)
        dealt.append(one.withColumns({"fold": (F.col("fold") + i * n_folds).cast("int"), "mc_seed": F.lit(seed)}))
    return reduce(DataFrame.unionByName, dealt)


@dataclass(frozen=True)
class Measure:
    """A named metric. ``score(df, by, truth)`` returns (by, name) from the column that its kind names:
    ``predictions`` (a number or a label) or ``probabilities`` (an array, one per class)."""

    name: str
    kind: str
    score: Callable[[DataFrame, Sequence[str], str, str], DataFrame]


def of_predictions(name: str, metric: Callable[[Column, Column], Column]) -> Measure:
    """A measure from an aggregate expression of (truth, prediction)."""
    return Measure(
        name, "predictions", lambda df, by, truth, out: df.groupBy(*by).agg(metric(F.col(truth), F.col("predictions")).alias(out))
    )


def log_loss_of(truth: Column, probabilities: Column, least: float = 1e-15) -> Column:
    """Mean negative log of the probability given to the true class; ``truth`` is the class number from 0."""
    p = F.get(probabilities, truth.cast("int"))
    return -F.avg(F.log(F.greatest(F.lit(least), F.least(F.lit(1.0 - least), p))))


def roc_auc(df: DataFrame, by: Sequence[str], truth: str, score: str, out: str = "auc") -> DataFrame:
    """(by, out): the chance that a positive row (truth 1) scores above a negative one, a tie counting one half.

    Rows are counted per distinct score before anything is ordered, so one score may hold most
    rows, and the negatives below a score are a running total over range partitions: no group is
    sorted in one task. Rows without a score or a truth are left out; without positives or negatives
    the result is null.
    """
    known = df.where(F.col(score).isNotNull() & F.col(truth).isNotNull())
    counts = known.groupBy(*by, F.col(score).alias("_score")).agg(
        F.count_if(F.col(truth) == 1).alias("_pos"), F.count_if(F.col(truth) != 1).alias("_neg")
    )
    placed = running_total_by(counts, by, ["_score"], "_neg", "_to")
    won = F.sum(F.col("_pos") * (F.col("_to") - F.col("_neg") / 2))
    return placed.groupBy(*by).agg(F.try_divide(won, (F.sum("_pos") * F.sum("_neg")).cast("double")).alias(out))


#: Measures of classifiers with two classes (``roc_auc``) or any number of them.
LOG_LOSS = Measure(
    "log_loss", "probabilities", lambda df, by, truth, out: df.groupBy(*by).agg(log_loss_of(F.col(truth), F.col("probabilities")).alias(out))
)
ROC_AUC = Measure(
    "auc", "probabilities", lambda df, by, truth, out: roc_auc(df.withColumn("_p", F.get("probabilities", F.lit(1))), by, truth, "_p", out)
)


def with_whole(predictions: DataFrame) -> DataFrame:
    """Every row in its fold and in fold ``WHOLE``."""
    return predictions.withColumn("fold", F.explode(F.array("fold", F.lit(WHOLE))))


def statistics(predictions: DataFrame, measures: Sequence[Measure], truth: str) -> DataFrame:
    """(modelName, mc_seed, fold, measures...) per fold and, as fold ``WHOLE``, over all test rows of each seed."""
    levels = with_whole(predictions)
    by = ["modelName", "mc_seed", "fold"]
    tables = [m.score(levels, by, truth, m.name) for m in measures]
    return reduce(lambda a, b: a.join(b, by, "full"), tables)


def described(model: PipelineModel) -> tuple[int | None, str]:
    """Boosting rounds (or trees) of a fitted model, and the settings of its last stage by name."""
    last = model.stages[-1] if hasattr(model, "stages") else model
    rounds = getattr(last, "getNumTrees", None)
    rounds = rounds() if callable(rounds) else rounds
    fixed = {p.name: v for p, v in last.extractParamMap().items() if last.isSet(p) and not p.name.endswith("Col")}
    return rounds, "; ".join(f"{n} = {fixed[n]}" for n in sorted(fixed))


@dataclass(frozen=True)
class CrossValidation:
    """Scores per (model, seed, fold) with rounds and settings of each fit, and the stored test predictions."""

    statistics: DataFrame
    predictions: DataFrame

    def summary(self, names: Sequence[str]) -> DataFrame:
        """Mean and sample deviation of every metric over the folds of each model."""
        aggs = [a for n in names for a in (F.avg(n).alias(f"{n}_mean"), F.stddev_samp(n).alias(f"{n}_std"))]
        per_fold = self.statistics.where(F.col("fold") != WHOLE)
        return per_fold.groupBy("modelName").agg(F.count(F.lit(1)).alias("n_folds"), *aggs)


def cross_validate(
    folded: DataFrame,
    candidates: Mapping[str, Callable[[], Estimator]],
    label: str,
    measures: Sequence[Measure],
    keys: Sequence[str],
    threads: int = 4,
) -> CrossValidation:
    """Fit every candidate on the training rows of every fold and score its test rows.

    Models are fitted side by side; their number is that of candidates and folds, not of rows.
    """
    roles = ["role"] if "role" in folded.columns else []
    rows = stage(folded, "cv-folds", by=["mc_seed", "fold", *roles])
    # One row per fold, read from the folders' names.
    plan = sorted((r.mc_seed, r.fold) for r in rows.select("mc_seed", "fold").distinct().collect())
    kinds = {m.kind for m in measures}

    def one(job: tuple[str, tuple[int, int]]) -> tuple[DataFrame, tuple]:
        name, (seed, fold) = job
        own, here = rows.where(F.col("mc_seed") == seed), F.col("fold") == fold
        train = own.where(here & (F.col("role") == "train") if roles else ~here)
        test = own.where(here & (F.col("role") == "test") if roles else here)
        model = candidates[name]().fit(train)
        scored = model.transform(test)
        found = [F.col("prediction").alias("predictions")]
        if "probabilities" in kinds:
            found.append(vector_to_array("probability").alias("probabilities"))
        scored = scored.select(F.lit(name).alias("modelName"), "mc_seed", "fold", *keys, label, *found)
        return stage(scored, "cv-scored"), (name, seed, fold, *described(model))

    jobs = [(name, f) for name in candidates for f in plan]
    with ThreadPoolExecutor(threads) as pool:
        done = list(pool.map(one, jobs))
    spark = folded.sparkSession
    fits = spark.createDataFrame([fit for _, fit in done], "modelName string, mc_seed int, fold int, rounds int, params string")
    predictions = reduce(DataFrame.unionByName, [scored for scored, _ in done])
    scores = statistics(predictions, measures, label).join(F.broadcast(fits), ["modelName", "mc_seed", "fold"], "left")
    return CrossValidation(scores.orderBy("modelName", "mc_seed", "fold"), predictions)
