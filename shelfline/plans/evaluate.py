"""Scoring of a weekly forecast over the whole hierarchy."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from shelfline.lineage import stage
from shelfline.operators import metrics
from shelfline.operators.hierarchy import LEVELS, level_name, roll_up
from shelfline.sources import retail

STEP = 7
WEEKS = 4
SPLIT = date(2001, 10, 1)


def naive_forecast(sold: DataFrame, split: date, periods: int, step_days: int) -> DataFrame:
    """The value ``periods`` steps earlier: the last training rows with their dates moved."""
    span = periods * step_days
    recent = sold.filter((F.col("date") > F.lit(split - timedelta(days=span))) & (F.col("date") <= F.lit(split)))
    return recent.withColumn("date", F.date_add("date", span))


class HierarchyScore:
    """Scale, weights and scaled error of the twelve levels for one train/validation split."""

    def __init__(self, sold: DataFrame, prices: DataFrame, split: date, periods: int = WEEKS, step_days: int = STEP, history_days: int | None = None):
        self.sold, self.split, self.periods, self.step_days = sold, split, periods, step_days
        first = F.lit(split - timedelta(days=history_days)) if history_days else None
        self.train = sold.filter(F.col("date") <= F.lit(split))
        if first is not None:
            self.train = self.train.filter(F.col("date") > first)
        end = split + timedelta(days=periods * step_days)
        self.truth = sold.filter((F.col("date") > F.lit(split)) & (F.col("date") <= F.lit(end)))
        self.prices = prices

    def train_nodes(self) -> DataFrame:
        return roll_up(self.train, {"demand": "demand"}, ["date"])

    def scale(self) -> DataFrame:
        return metrics.series_scale(self.train_nodes(), self.split, self.step_days)

    def weights(self) -> DataFrame:
        weekly = self.train.withColumn("wm_yr_wk", retail.week_code("date"))
        valued = metrics.leaf_value(weekly, self.prices, self.split, self.periods * self.step_days)
        return metrics.node_weights(valued)

    def rmsse(self, forecast: DataFrame) -> DataFrame:
        return metrics.with_rmsse(self.scale(), self.errors(forecast), self.periods)

    def errors(self, forecast: DataFrame) -> DataFrame:
        return metrics.leaf_errors(self.truth, forecast, retail.IDS)

    def contributors(self, forecast: DataFrame) -> DataFrame:
        return metrics.contributors(self.scale(), self.weights(), self.errors(forecast), self.periods)


def weekly_score(spark: SparkSession, sf_dir: str) -> tuple[HierarchyScore, DataFrame]:
    """Score object and naive forecast of the weekly series over the last four weeks."""
    sold = retail.staged_weekly_sold(spark, sf_dir)
    job = HierarchyScore(sold, retail.prices_of(sold), SPLIT)
    return job, naive_forecast(sold, SPLIT, WEEKS, STEP)


@dataclass(frozen=True)
class Process:
    """A forecast process: ``forecast(train, split, periods, step_days)`` gives rows like ``train`` for the
    periods after ``split``; ``inverse`` takes its values back to the scale of the truth."""

    name: str
    forecast: Callable[[DataFrame, date, int, int], DataFrame]
    inverse: Callable[[Column], Column] | None = None


def recent_mean(sold: DataFrame, split: date, periods: int, step_days: int) -> DataFrame:
    """Mean of the last ``periods`` training values, repeated over the horizon."""
    span = periods * step_days
    recent = sold.filter((F.col("date") > F.lit(split - timedelta(days=span))) & (F.col("date") <= F.lit(split)))
    level = recent.groupBy(*retail.IDS).agg((F.sum("demand") / periods).alias("demand"))
    days = [F.lit(split + timedelta(days=step_days * (i + 1))) for i in range(periods)]
    return level.withColumn("date", F.explode(F.array(*days)))


def log_line(window: int) -> Callable[[DataFrame, date, int, int], DataFrame]:
    """A line per series, fitted by least squares to log(1 + demand) of the last ``window`` periods.

    The forecast stays on the log scale and is at least 0. Periods without a row count as 0, so the
    sums over time have a closed form and only rows that exist are summed.
    """

    def forecast(sold: DataFrame, split: date, periods: int, step_days: int) -> DataFrame:
        first = split - timedelta(days=window * step_days)
        recent = sold.filter((F.col("date") > F.lit(first)) & (F.col("date") <= F.lit(split)))
        x, y = -F.datediff(F.lit(split), "date") / step_days, F.log1p("demand")
        sums = recent.groupBy(*retail.IDS).agg(F.sum(y).alias("_y"), F.sum(x * y).alias("_xy"))
        total, squares = -window * (window - 1) / 2, (window - 1) * window * (2 * window - 1) / 6
        slope = (window * F.col("_xy") - total * F.col("_y")) / (window * squares - total * total)
        line = sums.withColumns({"_b": slope, "_a": (F.col("_y") - slope * total) / window})
        ahead = F.explode(F.array(*(F.lit(i + 1) for i in range(periods))))
        line = line.withColumn("_h", ahead)
        return line.select(*retail.IDS, F.date_add(F.lit(split), F.col("_h") * step_days).alias("date"), F.greatest(F.col("_a") + F.col("_b") * F.col("_h"), F.lit(0.0)).alias("demand"))

    return forecast


def _folds_of(history: DataFrame, splits: Sequence[date], train_days: int, value_days: int, step_days: int) -> DataFrame:
    """(level, node, fold, scale, value) of node rows (level, node, date, demand, value).

    Squared differences between a node's sales are running totals along its dates; a fold takes
    the difference of the totals at its last and its first sale, so a row is read once for all
    folds. A node has at most one row per date.
    """
    node = Window.partitionBy(*metrics.NODE).orderBy("date")
    x, before = F.col("demand"), F.lag("demand").over(node)
    gap = F.datediff("date", F.lag("date").over(node))
    rise = F.when(gap == step_days, (x - before) * (x - before)).otherwise(before * before + x * x)
    sales = history.where(x != 0).withColumn("_rise", F.coalesce(rise, F.lit(0.0)))
    sales = sales.withColumn("_to", F.sum("_rise").over(node.rowsBetween(Window.unboundedPreceding, 0)))
    aggs = []
    for i, split in enumerate(splits):
        inside = (F.col("date") > F.lit(split - timedelta(days=train_days))) & (F.col("date") <= F.lit(split))
        late = (F.col("date") > F.lit(split - timedelta(days=value_days))) & (F.col("date") <= F.lit(split))
        aggs += [
            F.min(F.when(inside, F.struct("date", "_to"))).alias(f"_first{i}"),
            F.max(F.when(inside, F.struct("date", "_to", "demand"))).alias(f"_last{i}"),
            F.sum(F.when(late, F.col("value"))).alias(f"_value{i}"),
        ]
    per_fold = []
    for i, split in enumerate(splits):
        first, last = F.col(f"_first{i}"), F.col(f"_last{i}")
        falls = F.when(last["date"] < F.lit(split), last["demand"] * last["demand"]).otherwise(0.0)
        periods = F.datediff(F.lit(split), first["date"]) / step_days
        scale = F.try_divide(last["_to"] - first["_to"] + falls, periods)
        per_fold.append(F.struct(F.lit(i).alias("fold"), scale.alias("scale"), F.col(f"_value{i}").alias("value")))
    return sales.groupBy(*metrics.NODE).agg(*aggs).select(*metrics.NODE, F.explode(F.array(*per_fold)).alias("_f")).select(*metrics.NODE, "_f.*")


def backtest(
    sold: DataFrame,
    prices: DataFrame,
    processes: Sequence[Process],
    last: date,
    n_folds: int,
    train_periods: int,
    test_periods: int,
    step_days: int = STEP,
) -> DataFrame:
    """Every process on every fold: (process_name, fold_idx, date, preds_rmse, wrmsse).

    Fold i tests on ``test_periods`` periods and trains on the ``train_periods`` before them;
    the last fold ends at ``last``. Sales, their value and the errors of all processes and folds go through
    one roll-up of the hierarchy; scale and weights of every fold come from running totals
    of its nodes. Sparse forecasts and truths are compared, so the mean runs over all series
    that the data hold up to the end of the fold.
    """
    sold = stage(sold, "backtest-sold")
    test_days, train_days = test_periods * step_days, train_periods * step_days
    splits = [last - timedelta(days=(n_folds - i) * test_days) for i in range(n_folds)]
    start, runs = splits[0] - timedelta(days=train_days), len(processes)

    in_reach = sold.filter((F.col("date") > F.lit(start)) & (F.col("date") <= F.lit(last)))
    weekly = in_reach.withColumn("wm_yr_wk", retail.week_code("date")).join(prices, ["store_id", "item_id", "wm_yr_wk"], "left")
    history = weekly.select(*retail.IDS, "date", F.lit(-1).alias("run"), "demand", (F.col("demand") * F.col("sell_price")).alias("value"))
    # Errors are truth less forecast: signed rows of both, added up by the roll-up itself.
    none = F.lit(None).cast("double").alias("value")
    fold = F.floor((F.datediff("date", F.lit(splits[0])) - 1) / test_days).cast("int")
    truth = in_reach.filter(F.col("date") > F.lit(splits[0])).select(
        *retail.IDS, "date", F.explode(F.transform(F.sequence(F.lit(0), F.lit(runs - 1)), lambda p: fold * runs + p)).alias("run"), "demand", none
    )
    signed = [history, truth]
    for i, split in enumerate(splits):
        train = in_reach.filter((F.col("date") > F.lit(split - timedelta(days=train_days))) & (F.col("date") <= F.lit(split)))
        for p, process in enumerate(processes):
            made = process.forecast(train, split, test_periods, step_days)
            demand = process.inverse(F.col("demand")) if process.inverse else F.col("demand")
            signed.append(made.select(*retail.IDS, "date", F.lit(i * runs + p).alias("run"), (-demand).alias("demand"), none))
    nodes = stage(roll_up(reduce(DataFrame.unionByName, signed), {"demand": "demand", "value": "value"}, ["run", "date"]), "backtest-nodes")

    known = stage(_folds_of(nodes.where("run = -1").drop("run"), splits, train_days, test_days, step_days), "backtest-known")
    total = known.where(F.col("level") == level_name(LEVELS[0])).select("fold", F.col("value").alias("_total"))
    share = F.coalesce(F.try_divide("value", "_total"), F.lit(0.0)) / len(LEVELS)
    known = known.join(F.broadcast(total), "fold").select(*metrics.NODE, "fold", "scale", share.alias("weight"))

    errors = nodes.where("run >= 0").withColumn("fold", F.floor(F.col("run") / runs).cast("int"))
    square = F.col("demand") * F.col("demand")
    squares = errors.groupBy(*metrics.NODE, "fold", "run").agg((F.sum(square) / test_periods).alias("_mean"))
    parts = squares.join(known, [*metrics.NODE, "fold"])
    scores = parts.groupBy("run").agg(F.coalesce(F.sum(F.sqrt(F.try_divide("_mean", "scale")) * F.col("weight")), F.lit(0.0)).alias("wrmsse"))

    # A row per series, then one per fold: how many series the data hold up to its end.
    begun = sold.groupBy("id").agg(F.min("date").alias("_begin"))
    ends = [F.struct(F.lit(i).alias("fold"), F.count_if(F.col("_begin") <= F.lit(s + timedelta(days=test_days))).alias("_series")) for i, s in enumerate(splits)]
    series = begun.agg(F.array(*ends).alias("_s")).select(F.explode("_s").alias("_s")).select("_s.*")
    leaves = errors.where(F.col("level") == level_name(LEVELS[-1]))
    by_date = leaves.groupBy("run", "fold", "date").agg(F.sum(square).alias("_sq")).join(F.broadcast(series), "fold")
    out = by_date.join(F.broadcast(scores), "run", "left")
    names = F.array(*(F.lit(p.name) for p in processes))
    return out.select(
        F.get(names, F.col("run") % runs).alias("process_name"), F.col("fold").alias("fold_idx"), "date",
        F.sqrt(F.col("_sq") / F.col("_series")).alias("preds_rmse"), "wrmsse",
    )
