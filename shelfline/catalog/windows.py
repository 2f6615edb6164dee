"""Window functions along one series (daily grain)."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from shelfline.catalog.base import DAILY, query, r6
from shelfline.functions.rolling import along, rolling, running_sum, with_count_rolling, with_rolling_max
from shelfline.functions.scalars import ratio
from shelfline.operators.prices import (
    period_price_ratio,
    price_range_position,
    price_with_stats,
    with_price_per_day,
)
from shelfline.operators.runs import scaled_differences
from shelfline.operators.running import period_running_totals
from shelfline.sources import retail

def _w():
    """One series in date order."""
    return along("id", "date")

_LAGS = [0, 1, 2, 6, 7, 14, 28, 35, 42]


@query(
    "w01_lags",
    DAILY
    + "SELECT id, date, "
    + ", ".join(f"lag(demand, {k}) OVER w AS lag_{k}" for k in _LAGS)
    + " FROM daily WINDOW w AS (PARTITION BY id ORDER BY date)",
)
def lags(spark, sf):
    return retail.daily_series(spark, sf).select(
        "id", "date", *[F.lag("demand", k).over(_w()).alias(f"lag_{k}") for k in _LAGS]
    )


@query(
    "w02_shifted_target",
    DAILY
    + """, s AS (SELECT id, date, demand, lag(demand, 28) OVER (PARTITION BY id ORDER BY date) AS shifted_demand FROM daily)
SELECT * FROM s WHERE shifted_demand IS NOT NULL""",
)
def shifted_target(spark, sf):
    df = retail.daily_series(spark, sf).select("id", "date", "demand")
    return df.withColumn("shifted_demand", F.lag("demand", 28).over(_w())).filter("shifted_demand IS NOT NULL")


def _frame_sql(fn: str, n: int, shift: int = 0) -> str:
    over = f"(PARTITION BY id ORDER BY date ROWS BETWEEN {shift + n - 1} PRECEDING AND {shift} PRECEDING)"
    return f"round(CASE WHEN count(demand) OVER {over} = {n} THEN {fn}(demand) OVER {over} END, 6)"


def _family(name: str, fn: str, stat: str, sizes: list[int]) -> None:
    label = f"rolling_{stat}_t"
    sql = DAILY + "SELECT id, date, " + ", ".join(f"{_frame_sql(fn, n)} AS {label}{n}" for n in sizes) + " FROM daily"

    @query(name, sql)
    def run(spark, sf):
        df = retail.daily_series(spark, sf).select("id", "date", "demand")
        if stat in ("mean", "std", "sum"):
            out = with_count_rolling(df, _w(), "demand", [(f"{label}{n}", 0, n, stat) for n in sizes])
            return out.select("id", "date", *[r6(f"{label}{n}").alias(f"{label}{n}") for n in sizes])
        return df.select("id", "date", *[r6(rolling("demand", n, stat, _w())).alias(f"{label}{n}") for n in sizes])


_family("w03_rolling_mean", "avg", "mean", [7, 14, 28, 30, 60, 90, 180])
_family("w04_rolling_std", "stddev_samp", "std", [7, 30, 60, 90, 180])
_family("w05_rolling_sum", "sum", "sum", [7, 30])
_family("w06_rolling_skew", "skewness", "skew", [30])
_family("w07_rolling_kurt", "kurtosis", "kurt", [30])
_family("w08_rolling_max", "max", "max", [7, 30])

_STEP3 = (
    [(28, n, s) for s in ("mean", "std", "sum") for n in (7, 14, 30, 60, 180)]
    + [(k, n, "mean") for k in (1, 7, 14) for n in (7, 14, 30, 60)]
)
_FN = {"mean": "avg", "std": "stddev_samp", "sum": "sum"}
_SHIFTS = list(range(28, 43))


@query(
    "w09_lag_then_roll",
    DAILY
    + "SELECT id, date, "
    + ", ".join(f"{_frame_sql(_FN[s], n, k)} AS rolling_{s}_{k}_{n}" for k, n, s in _STEP3)
    + ", "
    + ", ".join(f"lag(demand, {k}) OVER (PARTITION BY id ORDER BY date) AS sales_lag_{k}" for k in _SHIFTS)
    + " FROM daily",
)
def lag_then_roll(spark, sf):
    specs = [(f"rolling_{s}_{k}_{n}", k, n, s) for k, n, s in _STEP3]
    df = retail.daily_series(spark, sf).select("id", "date", "demand")
    out = with_count_rolling(df, _w(), "demand", specs)
    return out.select(
        "id",
        "date",
        *[r6(name).alias(name) for name, *_ in specs],
        *[F.lag("demand", k).over(_w()).alias(f"sales_lag_{k}") for k in _SHIFTS],
    )


PRICED = DAILY + """, priced AS (
  SELECT daily.*, cal.wm_yr_wk, cal.month, cal.year, prices.sell_price
  FROM daily JOIN cal USING (date) LEFT JOIN prices USING (store_id, item_id, wm_yr_wk)
)"""


def _priced(spark, sf):
    """Daily rows with the price of their week."""
    sold = retail.staged_daily_sold(spark, sf)
    return with_price_per_day(retail.daily_series(spark, sf, sold), retail.prices_of(sold))


@query(
    "w10_price_partition_stats",
    DAILY
    + """SELECT store_id, item_id, wm_yr_wk, sell_price,
       max(sell_price) OVER p AS price_max, min(sell_price) OVER p AS price_min,
       round(stddev_samp(sell_price) OVER p, 6) AS price_std, round(avg(sell_price) OVER p + 1e-9, 6) AS price_mean,
       (SELECT count(DISTINCT q.sell_price) FROM prices q WHERE q.store_id = prices.store_id AND q.item_id = prices.item_id) AS price_nunique,
       (SELECT count(DISTINCT q.item_id) FROM prices q WHERE q.store_id = prices.store_id AND q.sell_price = prices.sell_price) AS item_nunique
FROM prices WINDOW p AS (PARTITION BY store_id, item_id)""",
)
def price_partition_stats(spark, sf):
    df = price_with_stats(retail.daily_prices(spark, sf))
    # A mean of cents can end exactly on half a unit of the last digit; the nudge settles such ties.
    return df.withColumns({"price_std": r6("price_std"), "price_mean": r6(F.col("price_mean") + 1e-9)}).drop("price_norm")


@query(
    "w11_price_momentum",
    DAILY
    + """SELECT store_id, item_id, wm_yr_wk, round(sell_price / lag(sell_price) OVER w, 6) AS price_momentum,
       round(sell_price / lag(sell_price) OVER w - 1, 6) AS sell_price_rel_diff
FROM prices WINDOW w AS (PARTITION BY store_id, item_id ORDER BY wm_yr_wk)""",
)
def price_momentum(spark, sf):
    w = along(["store_id", "item_id"], "wm_yr_wk")
    step = ratio(F.col("sell_price"), F.lag("sell_price").over(w))
    return retail.daily_prices(spark, sf).select(
        "store_id", "item_id", "wm_yr_wk", r6(step).alias("price_momentum"), r6(step - 1).alias("sell_price_rel_diff")
    )


@query(
    "w12_price_vs_month_year",
    PRICED
    + """SELECT id, date, round(sell_price / avg(sell_price) OVER (PARTITION BY store_id, item_id, month), 6) AS price_momentum_m,
       round(sell_price / avg(sell_price) OVER (PARTITION BY store_id, item_id, year), 6) AS price_momentum_y
FROM priced""",
)
def price_vs_month_year(spark, sf):
    return _priced(spark, sf).select(
        "id",
        "date",
        r6(period_price_ratio(["store_id", "item_id", "month"])).alias("price_momentum_m"),
        r6(period_price_ratio(["store_id", "item_id", "year"])).alias("price_momentum_y"),
    )


_MAX365 = "(PARTITION BY id ORDER BY date ROWS BETWEEN 365 PRECEDING AND 1 PRECEDING)"


@query(
    "w13_price_change",
    PRICED
    + f"""SELECT id, date,
       round((lag(sell_price) OVER w - sell_price) / lag(sell_price) OVER w, 6) AS price_change_t1,
       round((m365 - sell_price) / m365, 6) AS price_change_t365,
       round(sell_price / lag(sell_price) OVER w - 1, 6) AS price_change_1,
       round(sell_price / m365 - 1, 6) AS price_change_365
FROM (SELECT *, CASE WHEN count(sell_price) OVER {_MAX365} = 365 THEN max(sell_price) OVER {_MAX365} END AS m365 FROM priced)
WINDOW w AS (PARTITION BY id ORDER BY date)""",
)
def price_change(spark, sf):
    price, before, top = F.col("sell_price"), F.lag("sell_price").over(_w()), F.col("top")
    return with_rolling_max(_priced(spark, sf), "id", "date", "sell_price", 365, "top", shift=1).select(
        "id",
        "date",
        r6(ratio(before - price, before)).alias("price_change_t1"),
        r6(ratio(top - price, top)).alias("price_change_t365"),
        r6(ratio(price, before) - 1).alias("price_change_1"),
        r6(ratio(price, top) - 1).alias("price_change_365"),
    )


@query(
    "w14_price_norm",
    DAILY
    + "SELECT store_id, item_id, wm_yr_wk, round(sell_price / max(sell_price) OVER (PARTITION BY store_id, item_id), 6) AS price_norm FROM prices",
)
def price_norm(spark, sf):
    top = F.max("sell_price").over(Window.partitionBy("store_id", "item_id"))
    return retail.daily_prices(spark, sf).select(
        "store_id", "item_id", "wm_yr_wk", r6(ratio(F.col("sell_price"), top)).alias("price_norm")
    )


def _running_sql(columns: list[tuple[str, list[str], str]]) -> str:
    parts = []
    for name, keys, unit in columns:
        by = ", ".join([*keys, f"date_trunc('{unit}', date)"])
        parts.append(
            f"CASE WHEN shifted IS NOT NULL THEN sum(shifted) OVER (PARTITION BY {by} ORDER BY id, date ROWS UNBOUNDED PRECEDING) END AS {name}"
        )
    return (
        DAILY
        + ", s AS (SELECT *, lag(demand, 28) OVER (PARTITION BY id ORDER BY date) AS shifted FROM daily)\nSELECT id, date, "
        + ",\n ".join(parts)
        + " FROM s"
    )


def _shifted(spark, sf):
    return retail.daily_series(spark, sf).withColumn("shifted", F.lag("demand", 28).over(_w()))


@query(
    "w15_running_sum_by_id",
    _running_sql([("monthly_demand_by_id", ["id"], "month"), ("weekly_demand_by_id", ["id"], "week")]),
)
def running_by_id(spark, sf):
    def total(unit):
        return running_sum("shifted", Window.partitionBy("id", F.date_trunc(unit, "date")).orderBy("date"))

    return _shifted(spark, sf).select(
        "id", "date", total("month").alias("monthly_demand_by_id"), total("week").alias("weekly_demand_by_id")
    )


@query("w15_running_sum_by_store", _running_sql([("monthly_demand_by_store", ["store_id"], "month")]))
def running_by_store(spark, sf):
    out = period_running_totals(_shifted(spark, sf), {"monthly_demand_by_store": ("month", ["store_id"])}, "shifted")
    return out.select("id", "date", "monthly_demand_by_store")


@query("w15_running_sum_by_item", _running_sql([("weekly_demand_by_item_id", ["item_id"], "week")]))
def running_by_item(spark, sf):
    out = period_running_totals(_shifted(spark, sf), {"weekly_demand_by_item_id": ("week", ["item_id"])}, "shifted")
    return out.select("id", "date", "weekly_demand_by_item_id")


@query("w16_running_sum_all", _running_sql([("monthly_demand", [], "month"), ("weekly_demand", [], "week")]))
def running_all(spark, sf):
    names = {"monthly_demand": ("month", []), "weekly_demand": ("week", [])}
    return period_running_totals(_shifted(spark, sf), names, "shifted").select("id", "date", *names)


def _group_roll_sql(key: str) -> str:
    def over(n):
        return f"(PARTITION BY {key} ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"

    cols = ", ".join(
        f"CASE WHEN count(total) OVER {over(n)} = {n} THEN sum(total) OVER {over(n)} END AS rolling_sum_t{n}" for n in (7, 30)
    )
    return DAILY + f", t AS (SELECT {key}, date, sum(demand) AS total FROM daily GROUP BY ALL)\nSELECT {key}, date, {cols} FROM t"


def _group_roll(key: str):
    def run(spark, sf):
        totals = retail.daily_series(spark, sf).groupBy(key, "date").agg(F.sum("demand").alias("total"))
        w = along(key, "date")
        out = with_count_rolling(totals, w, "total", [(f"rolling_sum_t{n}", 0, n, "sum") for n in (7, 30)])
        return out.drop("total")

    return run


query("w17_store_rolling_sum", _group_roll_sql("store_id"))(_group_roll("store_id"))
query("w17_category_rolling_sum", _group_roll_sql("cat_id"))(_group_roll("cat_id"))


def _zeros_sql(n: int) -> str:
    over = f"(PARTITION BY id ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count(*) OVER {over} = {n} THEN CAST(count(*) FILTER (WHERE demand = 0) OVER {over} AS DOUBLE) END AS nb_zeros_rolling_t{n}"


@query("w18_rolling_zero_days", DAILY + f"SELECT id, date, {_zeros_sql(7)}, {_zeros_sql(30)} FROM daily")
def rolling_zero_days(spark, sf):
    df = retail.daily_series(spark, sf).select("id", "date", (F.col("demand") == 0).cast("int").alias("empty"))
    specs = [(f"nb_zeros_rolling_t{n}", 0, n, "sum") for n in (7, 30)]
    return with_count_rolling(df, _w(), "empty", specs).drop("empty")


@query(
    "w19_price_position",
    DAILY
    + """SELECT store_id, item_id, wm_yr_wk,
       round((sell_price - min(sell_price) OVER w) / (1 + max(sell_price) OVER w - min(sell_price) OVER w), 6) AS sell_price_cumrel
FROM prices WINDOW w AS (PARTITION BY store_id, item_id ORDER BY wm_yr_wk ROWS UNBOUNDED PRECEDING)""",
)
def price_position(spark, sf):
    w = along(["store_id", "item_id"], "wm_yr_wk")
    return retail.daily_prices(spark, sf).select(
        "store_id", "item_id", "wm_yr_wk", r6(price_range_position("sell_price", w)).alias("sell_price_cumrel")
    )


def _price_std_sql(n: int) -> str:
    over = f"(PARTITION BY id ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"round(CASE WHEN count(sell_price) OVER {over} = {n} THEN stddev_samp(sell_price) OVER {over} END, 6) AS rolling_price_std_t{n}"


@query("w20_rolling_price_std", PRICED + f"SELECT id, date, {_price_std_sql(7)}, {_price_std_sql(30)} FROM priced")
def rolling_price_std(spark, sf):
    return _priced(spark, sf).select(
        "id", "date", *[r6(rolling("sell_price", n, "std", _w())).alias(f"rolling_price_std_t{n}") for n in (7, 30)]
    )


@query(
    "w21_row_number",
    DAILY + "SELECT id, date, CAST(row_number() OVER (PARTITION BY id ORDER BY date) AS INTEGER) AS n FROM daily",
)
def row_number(spark, sf):
    return retail.daily_series(spark, sf).select("id", "date", F.row_number().over(_w()).alias("n"))


@query(
    "w22_squared_differences",
    DAILY
    + """, f AS (SELECT id, min(date) AS first_day FROM daily WHERE demand <> 0 GROUP BY id),
d AS (SELECT id, date, demand - lag(demand) OVER (PARTITION BY id ORDER BY date) AS diff FROM daily)
SELECT d.id, d.date, diff * diff AS squared_diff FROM d JOIN f ON d.id = f.id AND d.date > f.first_day""",
)
def squared_differences(spark, sf):
    return scaled_differences(retail.daily_series(spark, sf), "id", "date", "demand")


@query(
    "w23_roll_on_lag_column",
    DAILY
    + """, l AS (SELECT id, date, lag(demand, 7) OVER w AS lag_7, lag(demand, 28) OVER w AS lag_28 FROM daily WINDOW w AS (PARTITION BY id ORDER BY date))
SELECT id, date, """
    + ", ".join(
        f"round(CASE WHEN count(lag_{k}) OVER w{n} = {n} THEN avg(lag_{k}) OVER w{n} END, 6) AS rmean_{k}_{n}"
        for k in (7, 28)
        for n in (7, 28)
    )
    + """ FROM l WINDOW w7 AS (PARTITION BY id ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW),
w28 AS (PARTITION BY id ORDER BY date ROWS BETWEEN 27 PRECEDING AND CURRENT ROW)""",
)
def roll_on_lag_column(spark, sf):
    specs = [(f"rmean_{k}_{n}", k, n, "mean") for k in (7, 28) for n in (7, 28)]
    df = retail.daily_series(spark, sf).select("id", "date", "demand")
    out = with_count_rolling(df, _w(), "demand", specs)
    return out.select("id", "date", *[r6(name).alias(name) for name, *_ in specs])
