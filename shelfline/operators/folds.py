"""Splits and folds. Every split is a rule on the row, so no fold table is joined.

A fold label is (fold, role); a row may carry several of them.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfline.functions.scalars import seeded_hash
from shelfline.operators.running import positions, running_total_by

DAY = 24 * 3600


def _labelled(df: DataFrame, labels: Sequence[Column]) -> DataFrame:
    """Explode the non-null (fold, role) labels of each row."""
    return df.withColumn("_label", F.explode(F.array_compact(F.array(*labels)))).select(
        *df.columns, "_label.fold", "_label.role"
    )


def _label(condition: Column, fold: int, role: str) -> Column:
    return F.when(condition, F.struct(F.lit(fold).alias("fold"), F.lit(role).alias("role")))


def day_slices(df: DataFrame, number: Column, first: int, last: int, max_lags: int, horizon: int) -> DataFrame:
    """Train days first..last and test days last-max_lags..last+horizon, as ``role``."""
    roles = F.array_compact(
        F.array(
            F.when(number.between(first, last), "train"),
            F.when(number.between(last - max_lags, last + horizon), "test"),
        )
    )
    return df.withColumn("role", F.explode(roles))


def sliding_time_folds(df: DataFrame, day: str, n_splits: int, train_days: int, test_days: int) -> DataFrame:
    """Sliding train/test windows that step by half the test length and end at the last day.

    The last fold's test window is open-ended; a single split uses the latest windows.
    """
    last = df.agg(F.max(day)).scalar()
    back = F.datediff(last, F.col(day))
    labels = []
    for i in range(n_splits):
        shift = (n_splits - 1 - i) * test_days / 2
        # Distances from the last day; larger is earlier.
        start, middle, end = shift + test_days + train_days, shift + test_days, shift
        labels.append(_label((back <= start) & (back > middle), i, "train"))
        in_test = back <= middle if i == n_splits - 1 else (back <= middle) & (back > end)
        labels.append(_label(in_test, i, "test"))
    return _labelled(df, labels)


def backtest_folds(df: DataFrame, day: str, n_folds: int, train_days: int, test_days: int) -> DataFrame:
    """Fold i trains on ``train_days`` distinct dates and tests on the next ``test_days``.

    The distinct dates are one row per calendar day, so numbering them in one task is bounded.
    """
    dates = df.select(day).distinct()
    numbered = dates.withColumn("_pos", F.row_number().over(Window.orderBy(F.desc(day))) - 1)
    joined = df.join(F.broadcast(numbered), day)
    labels = []
    for i in range(n_folds):
        ahead = (n_folds - i - 1) * test_days
        pos = F.col("_pos")
        labels.append(_label(pos.between(ahead + test_days, ahead + test_days + train_days - 1), i, "train"))
        labels.append(_label(pos.between(ahead, ahead + test_days - 1), i, "test"))
    return _labelled(joined, labels).drop("_pos")


def random_folds(df: DataFrame, key: str, k: int, seeds: Sequence[int]) -> DataFrame:
    """Repeated random k-fold: one row per (row, seed) with its test fold, numbered across seeds."""
    folds = [
        F.struct(F.lit(seed).alias("mc_seed"), (i * k + F.pmod(seeded_hash(seed, F.col(key)), F.lit(k))).cast("int").alias("fold"))
        for i, seed in enumerate(seeds)
    ]
    return df.withColumn("_f", F.explode(F.array(*folds))).select(*df.columns, "_f.mc_seed", "_f.fold")


def stratified_folds(df: DataFrame, key: str, label: str, k: int, seed: int) -> DataFrame:
    """Deal the rows of each label over k folds in a seeded random order.

    A frequent label is ordered across tasks, not in one.
    """
    marked = df.withColumns({"_h": seeded_hash(seed, F.col(key)), "_one": F.lit(1)})
    ranked = running_total_by(marked, [label], ["_h", key], "_one", "_n")
    return ranked.withColumn("fold", F.pmod(F.col("_n") - 1, F.lit(k)).cast("int")).drop("_h", "_one", "_n")


def group_folds(df: DataFrame, group: str, k: int) -> DataFrame:
    """Group k-fold: groups, largest first, are dealt forth and back over the folds.

    No group is split, and fold sizes differ by at most the largest group.
    """
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    ranked = positions(sizes, [F.desc("_n"), F.asc(group)], "_pos")
    turn, step = F.floor(F.col("_pos") / k) % 2, F.col("_pos") % k
    fold = F.when(turn == 0, step).otherwise(k - 1 - step).cast("int")
    return df.join(ranked.select(group, fold.alias("fold")), group)


def rolling_row_folds(df: DataFrame, order: Sequence[str], train: int, test: int) -> DataFrame:
    """Folds over row positions: fold f trains on [f*test, f*test+train) and tests on the next ``test`` rows."""
    total = df.agg(F.count(F.lit(1))).scalar()
    numbered = positions(df, order, "_pos").withColumn("_folds", F.floor((total - train) / test))
    pos, folds = F.col("_pos"), F.col("_folds")

    def between(low: Column, high: Column, role: str) -> Column:
        low = F.greatest(low, F.lit(0)).cast("int")
        high = F.least(high, folds - 1).cast("int")
        found = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
        return F.transform(found, lambda f: F.struct(f.alias("fold"), F.lit(role).alias("role")))

    in_train = between(F.floor((pos - train) / test) + 1, F.floor(pos / test), "train")
    in_test = between(F.floor((pos - train - test) / test) + 1, F.floor((pos - train) / test), "test")
    out = numbered.withColumn("_label", F.explode(F.concat(in_train, in_test)))
    return out.select(*df.columns, "_label.fold", "_label.role")


def evaluation_split(
    df: DataFrame,
    how: str,
    key: str,
    size: float = 0.2,
    seed: int = 0,
    label: str | None = None,
    day: str | None = None,
    start: date | None = None,
) -> DataFrame:
    """Mark validation rows for early stopping in ``is_validation``.

    * ``random``: ``round(size * rows)`` rows in seeded order
    * ``stratified``: the same share of each label
    * ``date``: rows after ``start``
    * ``first``: the first ``size`` rows (or that share, when below 1) by ``key`` are training rows
    """
    if how == "date":
        return df.withColumn("is_validation", F.col(day) > F.lit(start))
    if how == "first":
        limit = F.lit(size) if size > 1 else F.floor(df.agg(F.count(F.lit(1))).scalar() * size)
        return positions(df, [key], "_pos").withColumn("is_validation", F.col("_pos") >= limit).drop("_pos")
    hashed = df.withColumn("_h", seeded_hash(seed, F.col(key)))
    if how == "random":
        limit = F.round(df.agg(F.count(F.lit(1))).scalar() * size)
        return positions(hashed, ["_h", key], "_pos").withColumn("is_validation", F.col("_pos") < limit).drop("_h", "_pos")
    if how == "stratified":
        sizes = df.groupBy(label).agg(F.round(F.count(F.lit(1)) * size).alias("_limit"))
        ranked = running_total_by(hashed.withColumn("_one", F.lit(1)), [label], ["_h", key], "_one", "_n")
        return ranked.join(sizes, label).withColumn("is_validation", F.col("_n") <= F.col("_limit")).drop("_h", "_one", "_n", "_limit")
    raise ValueError("how must be 'random', 'stratified', 'date' or 'first'")


def fixed_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """Mark a random sample of exactly ``n`` rows in ``in_sample``; nothing is gathered in one place."""
    ranked = positions(df.withColumn("_h", seeded_hash(seed, F.col(key))), ["_h", key], "_pos")
    return ranked.withColumn("in_sample", F.col("_pos") < n).drop("_h", "_pos")


def check_cv_arguments(
    split_type: str, stratified: bool, n_folds: int, train_window: int | None, test_window: int | None
) -> None:
    """Reject argument combinations a cross-validation cannot run with."""
    if not isinstance(split_type, str):
        raise TypeError("split_type must be a string")
    if split_type not in ("random", "time", "feature"):
        raise ValueError("split_type must be 'random', 'time' or 'feature'")
    if not isinstance(stratified, bool):
        raise TypeError("stratified must be a boolean")
    if split_type == "random":
        if isinstance(n_folds, bool) or not isinstance(n_folds, int):
            raise TypeError("n_folds must be a whole number")
        if n_folds < 2:
            raise ValueError("n_folds must be at least 2")
    if split_type == "time":
        for name, size in (("train_window", train_window), ("test_window", test_window)):
            if size is None or size <= 0:
                raise ValueError(f"{name} must be a positive whole number for split_type 'time'")
