"""Feature sets over the base grain, composed of window, price and calendar expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from shelfline.functions import dates
from shelfline.functions.rolling import along, rolling, running_sum, with_count_rolling, with_rolling_max
from shelfline.functions.scalars import ratio
from shelfline.operators.prices import PRODUCT, period_price_ratio, price_momentum, price_range_position, price_with_stats
from shelfline.operators.running import period_running_totals
from shelfline.operators.runs import with_longest_zero_run
from shelfline.sources import retail

TARGET = "shifted_demand"

# Shifts and widths of the lag-then-roll family.
LAG_FAMILY = [(28, n, s) for s in ("mean", "std", "sum") for n in (7, 14, 30, 60, 180)] + [
    (k, n, "mean") for k in (1, 7, 14) for n in (7, 14, 30, 60)
]


def _series():
    return along("id", "date")


def lag_family(df: DataFrame, target: str = TARGET) -> DataFrame:
    return with_count_rolling(df, _series(), target, [(f"rolling_{s}_{k}_{n}", k, n, s) for k, n, s in LAG_FAMILY])


def price_changes(df: DataFrame) -> DataFrame:
    """Change against the previous day and the 365-day maximum, rolling std 7 and 30."""
    w = _series()
    price, before, top = F.col("sell_price"), F.lag("sell_price").over(w), F.col("_top")
    out = with_rolling_max(df, "id", "date", "sell_price", 365, "_top", shift=1)
    return out.withColumns(
        {
            "price_change_t1": ratio(before - price, before),
            "price_change_t365": ratio(top - price, top),
            "rolling_price_std_t7": rolling("sell_price", 7, "std", w),
            "rolling_price_std_t30": rolling("sell_price", 30, "std", w),
        }
    ).drop("_top")


def period_totals_by_id(df: DataFrame, target: str = TARGET) -> DataFrame:
    def total(unit: str):
        return running_sum(target, Window.partitionBy("id", F.date_trunc(unit, "date")).orderBy("date"))

    return df.withColumns({"monthly_demand_by_id": total("month"), "weekly_demand_by_id": total("week")})


def period_totals_by_group(df: DataFrame, target: str = TARGET) -> DataFrame:
    """Running totals per month and week over all series of a store and of an item."""
    units, groups = {"monthly": "month", "weekly": "week"}, {"store": ["store_id"], "item_id": ["item_id"]}
    totals = {f"{label}_demand_by_{g}": (unit, by) for label, unit in units.items() for g, by in groups.items()}
    return period_running_totals(df, totals, target)


def _date_columns(drop: set[str]) -> dict:
    flags = dates.edge_flags("date")
    return {n: c for n, c in {**dates.parts("date"), **flags}.items() if n not in drop}


def set_1(df: DataFrame, target: str = TARGET) -> DataFrame:
    """Lags, rolling moments, price changes, calendar parts, running totals, zero runs."""
    w = _series()
    sizes = [7, 30, 60, 90, 180]
    specs = [(f"rolling_{s}_t{n}", 0, n, s) for s in ("std", "mean") for n in sizes]
    specs += [(f"rolling_sum_t{n}", 0, n, "sum") for n in (7, 30)]
    out = with_count_rolling(df, w, target, specs)
    out = out.withColumns(
        {
            **{f"shift_t{k}": F.lag(target, k).over(w) for k in (0, 1, 2)},
            "rolling_skew_t30": rolling(target, 30, "skew", w),
            "rolling_kurt_t30": rolling(target, 30, "kurt", w),
        }
    )
    out = period_totals_by_id(price_changes(out), target)
    out = out.withColumns(_date_columns({"is_quarter_start", "is_month_end", "is_quarter_end", "is_year_start"}))
    out = out.withColumn("is_weekend", dates.is_weekend("date"))
    return with_longest_zero_run(out, "id", "date", target).drop("event_type_2", "event_name_2", "weekday", "wday")


def set_2(df: DataFrame, target: str = "demand") -> DataFrame:
    """Lags 7 and 28, rolling means of both, calendar parts."""
    out = with_count_rolling(df, _series(), target, [(f"rmean_{k}_{n}", k, n, "mean") for n in (7, 28) for k in (7, 28)])
    return out.withColumns(
        {
            **{f"lag_{k}": F.lag(target, k).over(_series()) for k in (7, 28)},
            "week": F.weekofyear("date"),
            "quarter": F.quarter("date"),
            "mday": F.dayofmonth("date"),
        }
    )


def set_3(df: DataFrame, target: str = TARGET) -> DataFrame:
    """Price family on daily rows, lag family, running totals by series, store and item, zero runs."""
    # The group totals read the rows twice, so they come before the wide window columns.
    out = period_totals_by_group(df, target)
    # One series is one (store, item) pair: its id keeps all windows in one partitioning.
    out = price_with_stats(out, product=["id"])
    out = out.withColumns(
        {
            "price_momentum": price_momentum("sell_price", _series()),
            "price_momentum_m": period_price_ratio(["id", "month"]),
            "price_momentum_y": period_price_ratio(["id", "year"]),
        }
    )
    out = lag_family(price_changes(out), target)
    out = out.withColumns({f"shift_t{k}": F.lag(target, k).over(_series()) for k in (0, 1, 2, 6, 7, 14)})
    out = period_totals_by_id(out, target)
    kept = _date_columns({"is_quarter_start", "is_month_end", "is_quarter_end", "is_year_start", "is_month_start"})
    out = out.withColumns({**kept, "is_weekend": dates.is_weekend("date")})
    return with_longest_zero_run(out, "id", "date", target).drop("cat_id", "event_type_2", "event_name_2", "weekday", "wday")


def weekly_price_features(prices: DataFrame, calendar: DataFrame) -> DataFrame:
    """Price family at weekly grain; a week belongs to the month and year of its first day."""
    weeks = calendar.groupBy("wm_yr_wk").agg(
        F.min_by("month", "date").alias("month"), F.min_by("year", "date").alias("year")
    )
    dated = price_with_stats(prices).join(F.broadcast(weeks), "wm_yr_wk", "left")
    return dated.withColumns(
        {
            "price_momentum": price_momentum("sell_price", along(PRODUCT, "wm_yr_wk")),
            "price_momentum_m": period_price_ratio([*PRODUCT, "month"]),
            "price_momentum_y": period_price_ratio([*PRODUCT, "year"]),
        }
    ).drop("month", "year", "sell_price")


# The columns of feature set 4, in order.
SET_4_COLUMNS = (
    ["id", "store_id", "d", "item_id", "dept_id", "cat_id", "release", "sell_price"]
    + ["price_max", "price_min", "price_std", "price_mean", "price_norm", "price_nunique", "item_nunique"]
    + ["price_momentum", "price_momentum_m", "price_momentum_y"]
    + ["event_name_1", "event_type_1", "event_name_2", "event_type_2", "snap_CA", "snap_TX", "snap_WI"]
    + ["tm_d", "tm_w", "tm_m", "tm_y", "tm_wm", "tm_dw", "tm_w_end"]
    + [f"enc_{k}_{s}" for k in ("cat_id", "dept_id", "item_id") for s in ("mean", "std")]
    + [f"sales_lag_{k}" for k in range(28, 43)]
    + [f"rolling_{s}_28_{n}" for n in (7, 14, 30, 60, 180) for s in ("mean", "std")]
    + [f"rolling_mean_{k}_{n}" for k in (1, 7, 14) for n in (7, 14, 30, 60)]
)

SET_4_TARGET_KEYS = [("cat_id",), ("dept_id",), ("item_id",)]


def set_4(df: DataFrame, price_features: DataFrame, encodings: DataFrame, target: str = TARGET) -> DataFrame:
    """Weekly price family, lags 28-42, rolling family, target encodings, calendar parts."""
    w = _series()
    out = lag_family(df, target)
    out = out.withColumns({f"sales_lag_{k}": F.lag(target, k).over(w) for k in range(28, 43)})
    out = out.join(price_features, [*PRODUCT, "wm_yr_wk"], "left").join(encodings.drop(*retail.IDS[1:]), "id", "left")
    out = out.withColumns(
        {
            "d": retail.day_number("date"),
            "tm_d": F.dayofmonth("date"),
            "tm_w": F.weekofyear("date"),
            "tm_m": F.month("date"),
            "tm_y": F.year("date"),
            "tm_wm": dates.week_of_month("date"),
            "tm_dw": dates.monday_zero("date"),
            "tm_w_end": dates.is_weekend("date"),
        }
    )
    return out.select(*SET_4_COLUMNS)


def legacy_lag28(df: DataFrame, target: str = "demand") -> DataFrame:
    """Lags 28-30 and rolling moments of the 28-day lag, with price changes and calendar parts."""
    w = _series()
    specs = [(f"rolling_mean_t{n}", 28, n, "mean") for n in (7, 30, 90, 180)]
    specs += [(f"rolling_std_t{n}", 28, n, "std") for n in (7, 30)]
    out = with_count_rolling(df, w, target, specs).withColumns(
        {
            **{f"lag_t{k}": F.lag(target, k).over(w) for k in (28, 29, 30)},
            "rolling_skew_t30": rolling(target, 30, "skew", w, shift=28),
            "rolling_kurt_t30": rolling(target, 30, "kurt", w, shift=28),
        }
    )
    parts = dates.parts("date")
    return price_changes(out).withColumns({n: parts[n] for n in ("year", "month", "week", "day", "dayofweek")})


def legacy_ratio(df: DataFrame, target: str = "demand") -> DataFrame:
    """Lags 7, 28, 29, rolling mean and max of the 28-day lag, price changes as ratio minus one."""
    w = _series()
    price, before = F.col("sell_price"), F.lag("sell_price").over(w)
    out = with_rolling_max(df, "id", "date", "sell_price", 365, "_top", shift=1)
    out = with_count_rolling(out, w, target, [(f"roll_mean_28_{n}", 28, n, "mean") for n in (7, 30, 90, 180)])
    return out.withColumns(
        {
            **{f"lag_{k}": F.lag(target, k).over(w) for k in (7, 28, 29)},
            **{f"roll_max_28_{n}": rolling(target, n, "max", w, shift=28) for n in (7, 30)},
            "price_change_1": ratio(price, before) - 1,
            "price_change_365": ratio(price, F.col("_top")) - 1,
            "wday": dates.sunday_one("date"),
            "mday": F.dayofmonth("date"),
            "week": dates.seven_day_week("date"),
            "month": F.month("date"),
            "year": F.year("date"),
        }
    ).drop("_top")


def legacy_price_position(prices: DataFrame) -> DataFrame:
    """Relative price step, position in the price range so far, rolling std of 7 weeks."""
    w = along(PRODUCT, "wm_yr_wk")
    return prices.withColumns(
        {
            "sell_price_rel_diff": price_momentum("sell_price", w) - 1,
            "sell_price_cumrel": price_range_position("sell_price", w),
            "sell_price_roll_sd7": rolling("sell_price", 7, "std", w),
        }
    )


def legacy_cumulative(df: DataFrame, price_features: DataFrame, target: str = "demand") -> DataFrame:
    """Rolling mean and std of the 28-day lag, joined with the price position features."""
    specs = [(f"rolling_mean_t{n}", 28, n, "mean") for n in (7, 30, 60, 90, 180)]
    specs += [(f"rolling_sd_t{n}", 28, n, "std") for n in (7, 30)]
    out = with_count_rolling(df, _series(), target, specs).withColumn("lag_t28", F.lag(target, 28).over(_series()))
    return out.join(price_features.drop("sell_price"), [*PRODUCT, "wm_yr_wk"], "left")
