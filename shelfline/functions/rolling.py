"""Window expressions over one series: lags, rolling statistics, running totals.

A rolling statistic of width ``n`` is null until the frame holds ``n`` non-null values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F


def along(keys: str | Sequence[str], order: str | Sequence[str]) -> WindowSpec:
    keys = [keys] if isinstance(keys, str) else list(keys)
    order = [order] if isinstance(order, str) else list(order)
    return Window.partitionBy(*keys).orderBy(*order)


def _skew(x: Column, n: int, over: WindowSpec) -> Column:
    return F.skewness(x).over(over) * ((n * (n - 1)) ** 0.5 / (n - 2))


def _kurt(x: Column, n: int, over: WindowSpec) -> Column:
    return ((n + 1) * F.kurtosis(x).over(over) + 6) * ((n - 1) / ((n - 2) * (n - 3)))


_STATS = {
    "mean": lambda x, n, over: F.avg(x).over(over),
    "std": lambda x, n, over: F.stddev_samp(x).over(over),
    "sum": lambda x, n, over: F.sum(x).over(over),
    "max": lambda x, n, over: F.max(x).over(over),
    "min": lambda x, n, over: F.min(x).over(over),
    "skew": _skew,
    "kurt": _kurt,
}


def rolling(x: Column | str, n: int, stat: str, w: WindowSpec, shift: int = 0) -> Column:
    """Statistic over the ``n`` rows that end ``shift`` rows before the current one."""
    x = F.col(x) if isinstance(x, str) else x
    frame = w.rowsBetween(-(shift + n - 1), -shift)
    return F.when(F.count(x).over(frame) == n, _STATS[stat](x, n, frame))


def with_rolling_max(
    df: DataFrame, key: str, day: str, x: str, n: int, out: str, shift: int = 0
) -> DataFrame:
    """Rolling maximum at constant cost per row, whatever the width.

    The series is cut into blocks of ``n`` rows. A frame of ``n`` rows covers the tail of one
    block and the head of the next, so its maximum is the larger of a running maximum from
    the back of the first block and one from the front of the second.
    """
    w = along(key, day)
    marked = df.withColumn("_pos", F.row_number().over(w) - 1).withColumn("_block", F.floor(F.col("_pos") / n))
    front = along([key, "_block"], "_pos").rowsBetween(Window.unboundedPreceding, 0)
    back = along([key, "_block"], "_pos").rowsBetween(0, Window.unboundedFollowing)
    marked = marked.withColumns(
        {
            "_front": F.max(x).over(front),
            "_back": F.max(x).over(back),
            "_seen": F.count(x).over(w.rowsBetween(Window.unboundedPreceding, 0)),
        }
    )
    first = shift + n - 1
    full = F.lag("_seen", shift).over(w) - F.lag("_seen", first + 1, 0).over(w) == n
    top = F.greatest(F.lag("_front", shift).over(w), F.lag("_back", first).over(w))
    return marked.withColumn(out, F.when(full, top)).drop("_pos", "_block", "_front", "_back", "_seen")


def running_sum(x: Column | str, w: WindowSpec) -> Column:
    """Running total that is null where the value itself is null."""
    x = F.col(x) if isinstance(x, str) else x
    return F.when(x.isNotNull(), F.sum(x).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def running(x: Column | str, stat: str, w: WindowSpec) -> Column:
    frame = w.rowsBetween(Window.unboundedPreceding, 0)
    return {"min": F.min, "max": F.max}[stat](x).over(frame)


def with_count_rolling(
    df: DataFrame, w: WindowSpec, x: str, specs: Sequence[tuple[str, int, int, str]]
) -> DataFrame:
    """Rolling sum, mean and std of a whole-number column at constant cost per row.

    ``specs`` holds (name, shift, width, stat). Each statistic is the difference of two
    running totals (count, sum, sum of squares) taken at two lags, so a width of 180 costs
    as much as a width of 7. The first value of the series is taken off first: totals of
    what is left are exact up to 2**53 however large the level of the series is. Use :func:`rolling` for
    fractional columns.
    """
    to_here = w.rowsBetween(Window.unboundedPreceding, 0)
    # The same for all rows from the first value on; the rows before it have no statistic.
    df = df.withColumn("_offset", F.coalesce(F.first(F.col(x).cast("double"), ignorenulls=True).over(to_here), F.lit(0.0)))
    v = F.col(x).cast("double") - F.col("_offset")
    totals = F.struct(
        F.count(v).over(to_here).alias("n"),
        F.coalesce(F.sum(v).over(to_here), F.lit(0.0)).alias("s"),
        F.coalesce(F.sum(v * v).over(to_here), F.lit(0.0)).alias("q"),
    )
    marked = df.withColumn("_totals", totals)
    offsets = sorted({k for _, shift, n, _ in specs for k in (shift, shift + n)})
    marked = marked.withColumns({f"_at_{k}": F.lag("_totals", k).over(w) for k in offsets})

    def change(part: str, shift: int, n: int) -> Column:
        earlier = F.coalesce(F.col(f"_at_{shift + n}.{part}"), F.lit(0))
        return F.col(f"_at_{shift}.{part}") - earlier

    out = {}
    for name, shift, n, stat in specs:
        s, q = change("s", shift, n), change("q", shift, n)
        value = {
            "sum": lambda: s + n * F.col("_offset"),
            "mean": lambda: (s + n * F.col("_offset")) / n,
            "std": lambda: F.sqrt(F.greatest(q * n - s * s, F.lit(0.0)) / (n * (n - 1))),
        }[stat]()
        out[name] = F.when(change("n", shift, n) == n, value)
    return marked.withColumns(out).drop("_totals", "_offset", *[f"_at_{k}" for k in offsets])
