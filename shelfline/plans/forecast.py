"""Forecast jobs: closed-form and model-driven recursion, blending, submission."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from datetime import date, timedelta
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from shelfline.lineage import stage
from shelfline.operators.reshape import horizon_label, pivot, swap_suffix

# Multipliers of the blended recursive runs, each with the same weight.
ALPHAS = [1.035, 1.03, 1.025]


def mean_of_lags(lags: Sequence[int]) -> Callable[[Column], Column]:
    """Predictor over a history array (newest last): mean of the values ``lags`` steps back."""

    def predict(history: Column) -> Column:
        total = sum((F.element_at(history, -k) for k in lags[1:]), F.element_at(history, -lags[0]))
        return total / len(lags)

    return predict


def recursive_closed_form(
    history: DataFrame,
    last: date,
    steps: int,
    keep: int,
    predict: Callable[[Column], Column],
    alphas: Sequence[float] = (1.0,),
) -> DataFrame:
    """Recursive forecast with a predictor that is a column expression: (id, alpha, date, pred).

    The last ``keep`` values of a series are one short array per row, and the whole
    recursion is a fold over it: one shuffle for any number of steps.
    """
    recent = history.filter((F.col("date") > F.lit(last - timedelta(days=keep))) & (F.col("date") <= F.lit(last)))
    arrays = recent.groupBy("id").agg(
        F.expr("transform(sort_array(collect_list(struct(date, demand))), p -> p.demand)").alias("_h")
    )
    arrays = arrays.select("id", "_h", F.explode(F.array(*[F.lit(a) for a in alphas])).alias("alpha"))
    grown = F.aggregate(
        F.sequence(F.lit(1), F.lit(steps)), F.col("_h"), lambda h, _: F.concat(h, F.array(F.col("alpha") * predict(h)))
    )
    ahead = F.slice(grown, F.size("_h") + 1, steps)
    out = arrays.select("id", "alpha", F.posexplode(ahead).alias("_step", "pred"))
    return out.select("id", "alpha", F.date_add(F.lit(last), F.col("_step") + 1).alias("date"), "pred")


def recursive_with_model(
    history: DataFrame,
    last: date,
    steps: int,
    keep: int,
    features: Callable[[DataFrame], DataFrame],
    model,
    alpha: float = 1.0,
) -> DataFrame:
    """Recursive forecast with a fitted model: (id, date, pred).

    ``features`` maps (id, date, demand) rows to feature rows; only the last ``keep`` days are
    read in a step. Each day is a written table, so no plan holds the steps before it.
    """
    recent = history.filter(F.col("date") > F.lit(last - timedelta(days=keep))).select("id", "date", "demand")
    recent = stage(recent, "recursion-history")
    days: list[DataFrame] = []
    for step in range(1, steps + 1):
        day = last + timedelta(days=step)
        empty = F.lit(None).cast("double")
        today = recent.select("id").distinct().select("id", F.lit(day).alias("date"), empty.alias("demand"))
        oldest = F.lit(day - timedelta(days=keep + 1))
        state = reduce(DataFrame.unionByName, days[-keep:], recent.filter(F.col("date") > oldest))
        scored = model.transform(features(state.unionByName(today)).filter(F.col("date") == F.lit(day)))
        days.append(stage(scored.select("id", "date", (alpha * F.col("prediction")).alias("demand")), "recursion-day"))
    return reduce(DataFrame.unionByName, days).withColumnRenamed("demand", "pred")


def recursive_with_arrays(
    history: DataFrame,
    last: date,
    steps: int,
    keep: int,
    features: Callable[[np.ndarray, date], np.ndarray],
    model,
    alpha: float = 1.0,
) -> DataFrame:
    """Recursive forecast with a model as arrays (``plans.scoring.as_arrays``): (id, date, pred), in one job.

    The last ``keep`` days of a series are one short array (a day without a row is 0), found
    by one shuffle; a batch of series then goes through all steps as a matrix. ``features`` maps that matrix
    (newest last) and the day to feature rows; ``model.predict`` maps those to forecasts.
    """
    first = last - timedelta(days=keep - 1)
    recent = history.where(F.col("date").between(F.lit(first), F.lit(last)))
    cells = F.map_from_entries(F.collect_list(F.struct(F.datediff("date", F.lit(first)).alias("k"), F.col("demand").cast("double").alias("v"))))
    dense = F.transform(F.sequence(F.lit(0), F.lit(keep - 1)), lambda k: F.coalesce(F.try_element_at("_h", k), F.lit(0.0)))
    arrays = recent.groupBy("id").agg(cells.alias("_h")).select("id", dense.alias("h"))
    kind = arrays.schema["id"].dataType.simpleString()
    days = [last + timedelta(days=n) for n in range(1, steps + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            state = np.asarray(batch.column("h").flatten()).reshape(n, keep) if n else np.zeros((0, keep))
            found = np.empty((n, steps))
            for i, day in enumerate(days):
                found[:, i] = alpha * model.predict(features(state, day))
                state = np.concatenate([state[:, 1:], found[:, i : i + 1]], axis=1)
            ids = batch.column("id").take(pa.array(np.repeat(np.arange(n), steps)))
            yield pa.RecordBatch.from_arrays([ids, pa.array(days * n, pa.date32()), pa.array(found.ravel())], ["id", "date", "pred"])

    return arrays.mapInArrow(run, f"id {kind}, date date, pred double")


def blend(forecasts: DataFrame, weights: int) -> DataFrame:
    """Equal-weight blend of the runs: (id, date, pred)."""
    return forecasts.groupBy("id", "date").agg(F.sum(F.col("pred") / weights).alias("pred"))


def submission(forecast: DataFrame, template: DataFrame, first: date, horizon: int) -> DataFrame:
    """Wide table id, F1..Fn for every template id.

    The validation half is the forecast, the evaluation half keeps the template's values;
    ids without a forecast get 0.
    """
    labels = [f"F{n}" for n in range(1, horizon + 1)]
    labelled = forecast.withColumn("F", horizon_label(F.datediff("date", F.lit(first)) + 1))
    wide = pivot(labelled, ["id"], "F", labels, "pred").withColumn("id", F.concat("id", F.lit("_validation")))
    early = template.filter(F.col("id").endswith("_validation")).select("id").join(wide, "id", "left").na.fill(0.0, labels)
    late = template.filter(F.col("id").endswith("_evaluation")).select("id", *labels)
    return early.unionByName(late)


def mirrored_submission(forecast: DataFrame, first: date, horizon: int) -> DataFrame:
    """Wide table with the same forecast under both id suffixes."""
    labels = [f"F{n}" for n in range(1, horizon + 1)]
    labelled = forecast.withColumn("F", horizon_label(F.datediff("date", F.lit(first)) + 1))
    wide = pivot(labelled, ["id"], "F", labels, "pred").na.fill(0.0, labels).withColumn("id", F.concat("id", F.lit("_validation")))
    return wide.unionByName(wide.withColumn("id", swap_suffix("id", "_validation", "_evaluation")))


def replace_horizon_column(old: DataFrame, fresh: DataFrame, label: str) -> DataFrame:
    """Swap one horizon column of an older submission; ids without a new value get 0."""
    joined = old.drop(label).join(fresh.select("id", label), "id", "left").na.fill(0.0, [label])
    return joined.select(*old.columns)
