"""Base grain and feature sets."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, functions as F

from shelfline.catalog.aggregates import _RUNS
from shelfline.catalog.base import DAILY, query
from shelfline.catalog.encoders import target_encoding_sql
from shelfline.lineage import stage
from shelfline.operators.encode import target_encoding_table
from shelfline.plans import features
from shelfline.plans.grain import base_grain, hold_out
from shelfline.sources import retail

_CAL = ["weekday", "wday", "month", "year", "d", "event_name_1", "event_type_1", "event_name_2", "event_type_2", "snap_CA", "snap_TX", "snap_WI"]
_Q = ", ".join(f'"{c}"' for c in _CAL)


def base_sql(shift: int | None, horizon: bool = False) -> str:
    """CTE ``base``: the base grain, as in plans.grain."""
    future = "UNION ALL SELECT ids.*, cal.date, NULL FROM ids CROSS JOIN cal WHERE cal.dn > 2499" if horizon else ""
    shifted = f"lag(demand, {shift}) OVER (PARTITION BY id ORDER BY date)" if shift else "demand"
    keep = "WHERE shifted_demand IS NOT NULL" if shift else ""
    return (
        DAILY
        + f""", all_days AS (SELECT * FROM daily {future}),
release AS (SELECT store_id, item_id, min(wm_yr_wk) AS first_week FROM prices GROUP BY ALL),
released AS (
  SELECT id, item_id, dept_id, cat_id, store_id, state_id, a.date, demand, wm_yr_wk, {_Q}, sell_price, wm_yr_wk - first_week AS release
  FROM all_days a JOIN cal USING (date) LEFT JOIN prices USING (store_id, item_id, wm_yr_wk) JOIN release USING (store_id, item_id)
  WHERE wm_yr_wk >= first_week),
base AS (SELECT * FROM (SELECT *, {shifted} AS shifted_demand FROM released) {keep})
"""
    )


def _rounded(df: DataFrame, columns: list[str]) -> DataFrame:
    types = dict(df.dtypes)
    if "price_mean" in columns:
        # A mean of cents can end exactly on half a unit of the last digit; the nudge settles such ties.
        df = df.withColumn("price_mean", F.col("price_mean") + 1e-9)
    return df.select(*[F.round(c, 6).alias(c) if types[c] == "double" else F.col(c) for c in columns])


def _over(n: int, shift: int = 0) -> str:
    return f"(PARTITION BY id ORDER BY date ROWS BETWEEN {shift + n - 1} PRECEDING AND {shift} PRECEDING)"


def _roll(x: str, fn: str, n: int, name: str, shift: int = 0) -> str:
    o = _over(n, shift)
    return f"round(CASE WHEN count({x}) OVER {o} = {n} THEN {fn}({x}) OVER {o} END, 6) AS {name}"


def _lag(x: str, k: int, name: str) -> str:
    return f"lag({x}, {k}) OVER (PARTITION BY id ORDER BY date) AS {name}"


_FN = {"mean": "avg", "std": "stddev_samp", "sum": "sum"}
_BEFORE = "lag(sell_price) OVER (PARTITION BY id ORDER BY date)"
_TOP = f"(CASE WHEN count(sell_price) OVER {_over(365, 1)} = 365 THEN max(sell_price) OVER {_over(365, 1)} END)"
_PRICE_CHANGES = [
    f"round(({_BEFORE} - sell_price) / {_BEFORE}, 6) AS price_change_t1",
    f"round(({_TOP} - sell_price) / {_TOP}, 6) AS price_change_t365",
    _roll("sell_price", "stddev_samp", 7, "rolling_price_std_t7"),
    _roll("sell_price", "stddev_samp", 30, "rolling_price_std_t30"),
]
_PARTS = {
    "year": "CAST(year(date) AS INTEGER)",
    "quarter": "CAST(quarter(date) AS INTEGER)",
    "month": "CAST(month(date) AS INTEGER)",
    "week": "CAST(weekofyear(date) AS INTEGER)",
    "day": "CAST(day(date) AS INTEGER)",
    "dayofweek": "CAST(isodow(date) - 1 AS INTEGER)",
    "is_weekend": "CAST(isodow(date) >= 6 AS INTEGER)",
    "is_year_end": "CAST(date_trunc('year', date + 1) = date + 1 AS INTEGER)",
    "is_month_start": "CAST(date_trunc('month', date) = date AS INTEGER)",
}


def _parts(*names: str) -> list[str]:
    return [f"{_PARTS[n]} AS {n}" for n in names]


def _total(keys: str, unit: str, name: str) -> str:
    return f"sum(shifted_demand) OVER (PARTITION BY {keys}, date_trunc('{unit}', date) ORDER BY id, date ROWS UNBOUNDED PRECEDING) AS {name}"


_TOTALS_BY_ID = [_total("id", "month", "monthly_demand_by_id"), _total("id", "week", "weekly_demand_by_id")]


def _select(source: str, items: list[str], tail: str = "") -> str:
    return "SELECT " + ",\n ".join(items) + f"\nFROM {source} {tail}"


@query(
    "g06_base_grain",
    base_sql(28, horizon=True) + "SELECT * FROM base",
)
def base_rows(spark, sf):
    return base_grain(spark, sf, shift=28, horizon=28)


@query(
    "g06_loader_split",
    base_sql(28)
    + """SELECT 'train' AS part, id, date, shifted_demand, NULL::DOUBLE AS demand FROM base WHERE date <= DATE '2001-10-07'
UNION ALL SELECT 'target', id, date, NULL, demand FROM base WHERE date <= DATE '2001-10-07'
UNION ALL SELECT 'test', id, date, shifted_demand, NULL FROM base WHERE date > DATE '2001-10-07'
UNION ALL SELECT 'truth', id, date, NULL, demand FROM base WHERE date > DATE '2001-10-07'""",
)
def loader_split(spark, sf):
    """The four tables a loader hands out, stacked under their names."""
    df = base_grain(spark, sf, shift=28).select("id", "date", "shifted_demand", "demand")
    tables = hold_out(df, date(2001, 10, 7))
    out = None
    for name, part in tables.items():
        part = part.withColumn("part", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out.select("part", "id", "date", "shifted_demand", "demand")


_SET1 = (
    ["id", "item_id", "store_id", "date", "shifted_demand", "sell_price", "event_name_1", '"snap_CA"']
    + [_lag("shifted_demand", k, f"shift_t{k}") for k in (0, 1, 2)]
    + [_roll("shifted_demand", _FN[s], n, f"rolling_{s}_t{n}") for s in ("std", "mean") for n in (7, 30, 60, 90, 180)]
    + [_roll("shifted_demand", "sum", n, f"rolling_sum_t{n}") for n in (7, 30)]
    + [_roll("shifted_demand", "skewness", 30, "rolling_skew_t30"), _roll("shifted_demand", "kurtosis", 30, "rolling_kurt_t30")]
    + _PRICE_CHANGES
    + _TOTALS_BY_ID
    + _parts("year", "quarter", "month", "week", "day", "dayofweek", "is_weekend", "is_year_end", "is_month_start")
)
_SET1_NAMES = [i.split(" AS ")[-1].strip('"') for i in _SET1] + ["max_consecutive_zeros"]


def _runs_cte() -> str:
    body = _RUNS.format(src="src").lstrip(", ")
    head, tail = body.rsplit("SELECT ends.id", 1)
    return ", src AS (SELECT id, date, shifted_demand AS demand FROM base), " + head.rstrip() + ", zero_runs AS (SELECT ends.id" + tail + ")\n"


@query(
    "g01_feature_set_1",
    base_sql(28)
    + _runs_cte()
    + ", feats AS ("
    + _select("base", _SET1)
    + ")\nSELECT feats.*, max_consecutive_zeros FROM feats JOIN zero_runs USING (id)",
)
def feature_set_1(spark, sf):
    out = features.set_1(base_grain(spark, sf, shift=28))
    return _rounded(out, _SET1_NAMES)


_SET2 = (
    ["id", "date", "demand"]
    + [_lag("demand", k, f"lag_{k}") for k in (7, 28)]
    + [_roll("demand", "avg", n, f"rmean_{k}_{n}", k) for k in (7, 28) for n in (7, 28)]
    + ["wday", "month", "year"]
    + _parts("week", "quarter")
    + ["CAST(day(date) AS INTEGER) AS mday"]
)


@query("g02_feature_set_2", base_sql(None) + _select("base", _SET2))
def feature_set_2(spark, sf):
    out = features.set_2(base_grain(spark, sf))
    return _rounded(out, [i.split(" AS ")[-1] for i in _SET2])


_PAIR = "(PARTITION BY store_id, item_id)"
_FAMILY = [_roll("shifted_demand", _FN[s], n, f"rolling_{s}_{k}_{n}", k) for k, n, s in features.LAG_FAMILY]
_SET3 = (
    ["id", "item_id", "store_id", "date", "sell_price"]
    + [f"max(sell_price) OVER {_PAIR} AS price_max", f"min(sell_price) OVER {_PAIR} AS price_min"]
    + [f"round(stddev_samp(sell_price) OVER {_PAIR}, 6) AS price_std", f"round(avg(sell_price) OVER {_PAIR} + 1e-9, 6) AS price_mean"]
    + [f"round(sell_price / max(sell_price) OVER {_PAIR}, 6) AS price_norm", "price_nunique", "item_nunique"]
    + ["round(sell_price / lag(sell_price) OVER (PARTITION BY store_id, item_id ORDER BY date), 6) AS price_momentum"]
    + [
        f"round(sell_price / avg(sell_price) OVER (PARTITION BY store_id, item_id, {u}(date)), 6) AS price_momentum_{u[0]}"
        for u in ("month", "year")
    ]
    + _PRICE_CHANGES
    + _FAMILY
    + [_lag("shifted_demand", k, f"shift_t{k}") for k in (0, 1, 2, 6, 7, 14)]
    + _TOTALS_BY_ID
    + [_total("store_id", "month", "monthly_demand_by_store"), _total("store_id", "week", "weekly_demand_by_store")]
    + [_total("item_id", "month", "monthly_demand_by_item_id"), _total("item_id", "week", "weekly_demand_by_item_id")]
    + _parts("year", "quarter", "month", "week", "day", "dayofweek", "is_weekend", "is_year_end")
)
_SET3_NAMES = [i.split(" AS ")[-1] for i in _SET3] + ["max_consecutive_zeros"]


@query(
    "g03_feature_set_3",
    base_sql(28)
    + _runs_cte()
    + """, pn AS (SELECT store_id, item_id, count(DISTINCT sell_price) AS price_nunique FROM base GROUP BY ALL),
sn AS (SELECT store_id, sell_price, count(DISTINCT item_id) AS item_nunique FROM base WHERE sell_price IS NOT NULL GROUP BY ALL),
wide AS (SELECT * FROM base JOIN pn USING (store_id, item_id) LEFT JOIN sn USING (store_id, sell_price)),
feats AS ("""
    + _select("wide", _SET3)
    + ")\nSELECT feats.*, max_consecutive_zeros FROM feats JOIN zero_runs USING (id)",
)
def feature_set_3(spark, sf):
    # The group totals and the price family read the base grain again and again: it is written once.
    out = features.set_3(stage(base_grain(spark, sf, shift=28), "base-grain"))
    return _rounded(out, _SET3_NAMES)


_ENC4 = target_encoding_sql("early", "shifted_demand")


@query(
    "g04_feature_set_4",
    base_sql(28)
    + f""", wk AS (SELECT wm_yr_wk, min(month * 10000 + year) FILTER (WHERE dn % 7 = 1) AS my FROM cal GROUP BY 1),
pw AS (SELECT prices.*, my // 10000 AS m, my % 10000 AS y FROM prices LEFT JOIN wk USING (wm_yr_wk)),
pn AS (SELECT store_id, item_id, count(DISTINCT sell_price) AS price_nunique FROM prices GROUP BY ALL),
sn AS (SELECT store_id, sell_price, count(DISTINCT item_id) AS item_nunique FROM prices GROUP BY ALL),
pf AS (SELECT store_id, item_id, wm_yr_wk, max(sell_price) OVER {_PAIR} AS price_max, min(sell_price) OVER {_PAIR} AS price_min,
  round(stddev_samp(sell_price) OVER {_PAIR}, 6) AS price_std, round(avg(sell_price) OVER {_PAIR} + 1e-9, 6) AS price_mean,
  round(sell_price / max(sell_price) OVER {_PAIR}, 6) AS price_norm, price_nunique, item_nunique,
  round(sell_price / lag(sell_price) OVER (PARTITION BY store_id, item_id ORDER BY wm_yr_wk), 6) AS price_momentum,
  round(sell_price / avg(sell_price) OVER (PARTITION BY store_id, item_id, m), 6) AS price_momentum_m,
  round(sell_price / avg(sell_price) OVER (PARTITION BY store_id, item_id, y), 6) AS price_momentum_y
  FROM pw JOIN pn USING (store_id, item_id) JOIN sn USING (store_id, sell_price)),
early AS (SELECT * FROM base WHERE date <= DATE '2001-11-04' - 28),
"""
    + _ENC4[0]
    + ", feats AS (SELECT base.*, "
    + ", ".join(_FAMILY + [_lag("shifted_demand", k, f"sales_lag_{k}") for k in range(28, 43)])
    + " FROM base)\nSELECT "
    + ", ".join(
        {
            "d": "CAST(date_diff('day', DATE '1995-01-02', date) + 1 AS INTEGER) AS d",
            "tm_d": "CAST(day(date) AS INTEGER) AS tm_d",
            "tm_w": "CAST(weekofyear(date) AS INTEGER) AS tm_w",
            "tm_m": "CAST(month(date) AS INTEGER) AS tm_m",
            "tm_y": "CAST(year(date) AS INTEGER) AS tm_y",
            "tm_wm": "CAST(ceil(day(date) / 7.0) AS INTEGER) AS tm_wm",
            "tm_dw": "CAST(isodow(date) - 1 AS INTEGER) AS tm_dw",
            "tm_w_end": "CAST(isodow(date) >= 6 AS INTEGER) AS tm_w_end",
        }.get(c, f"round({c}, 6) AS {c}" if c.startswith("enc_") else f'"{c}"')
        for c in features.SET_4_COLUMNS
    )
    + " FROM feats LEFT JOIN pf USING (store_id, item_id, wm_yr_wk)\n"
    + _ENC4[1],
)
def feature_set_4(spark, sf):
    sold = retail.staged_daily_sold(spark, sf)
    df = stage(base_grain(spark, sf, shift=28, sold=sold), "base-grain")
    prices = features.weekly_price_features(retail.prices_of(sold), retail.calendar(spark, sold=sold))
    early = df.filter(F.col("date") <= F.lit(retail.SPAN_END - timedelta(days=28)))
    table = target_encoding_table(early, "shifted_demand", retail.IDS, features.SET_4_TARGET_KEYS)
    return _rounded(features.set_4(df, prices, table), features.SET_4_COLUMNS)


_LEGACY28 = (
    ["id", "date"]
    + [_lag("demand", k, f"lag_t{k}") for k in (28, 29, 30)]
    + [_roll("demand", "avg", n, f"rolling_mean_t{n}", 28) for n in (7, 30, 90, 180)]
    + [_roll("demand", "stddev_samp", n, f"rolling_std_t{n}", 28) for n in (7, 30)]
    + [_roll("demand", "skewness", 30, "rolling_skew_t30", 28), _roll("demand", "kurtosis", 30, "rolling_kurt_t30", 28)]
    + _PRICE_CHANGES
    + _parts("year", "month", "week", "day", "dayofweek")
)


@query("g05_legacy_lag28", base_sql(None) + _select("base", _LEGACY28))
def legacy_lag28(spark, sf):
    return _rounded(features.legacy_lag28(base_grain(spark, sf)), [i.split(" AS ")[-1] for i in _LEGACY28])


_LEGACY_RATIO = (
    ["id", "date"]
    + [_lag("demand", k, f"lag_{k}") for k in (7, 28, 29)]
    + [_roll("demand", "avg", n, f"roll_mean_28_{n}", 28) for n in (7, 30, 90, 180)]
    + [_roll("demand", "max", n, f"roll_max_28_{n}", 28) for n in (7, 30)]
    + [f"round(sell_price / {_BEFORE} - 1, 6) AS price_change_1", f"round(sell_price / {_TOP} - 1, 6) AS price_change_365"]
    + ["CAST(dayofweek(date) + 1 AS INTEGER) AS wday", "CAST(day(date) AS INTEGER) AS mday"]
    + ["CAST((dayofyear(date) - 1) // 7 + 1 AS INTEGER) AS week"]
    + _parts("month", "year")
)


@query("g05_legacy_ratio", base_sql(None) + _select("base", _LEGACY_RATIO))
def legacy_ratio(spark, sf):
    return _rounded(features.legacy_ratio(base_grain(spark, sf)), [i.split(" AS ")[-1] for i in _LEGACY_RATIO])


_P7 = "(PARTITION BY store_id, item_id ORDER BY wm_yr_wk ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)"
_LEGACY_CUM = (
    ["id", "date", "store_id", "item_id", "wm_yr_wk"]
    + [_lag("demand", 28, "lag_t28")]
    + [_roll("demand", "avg", n, f"rolling_mean_t{n}", 28) for n in (7, 30, 60, 90, 180)]
    + [_roll("demand", "stddev_samp", n, f"rolling_sd_t{n}", 28) for n in (7, 30)]
)


@query(
    "g05_legacy_cumulative",
    base_sql(None)
    + f""", pf AS (SELECT store_id, item_id, wm_yr_wk, round(sell_price / lag(sell_price) OVER w - 1, 6) AS sell_price_rel_diff,
 round((sell_price - min(sell_price) OVER c) / (1 + max(sell_price) OVER c - min(sell_price) OVER c), 6) AS sell_price_cumrel,
 round(CASE WHEN count(sell_price) OVER {_P7} = 7 THEN stddev_samp(sell_price) OVER {_P7} END, 6) AS sell_price_roll_sd7
 FROM prices WINDOW w AS (PARTITION BY store_id, item_id ORDER BY wm_yr_wk), c AS (PARTITION BY store_id, item_id ORDER BY wm_yr_wk ROWS UNBOUNDED PRECEDING)),
feats AS ("""
    + _select("base", _LEGACY_CUM)
    + ") SELECT * FROM feats LEFT JOIN pf USING (store_id, item_id, wm_yr_wk)",
)
def legacy_cumulative(spark, sf):
    prices = features.legacy_price_position(retail.daily_prices(spark, sf))
    out = features.legacy_cumulative(base_grain(spark, sf), prices)
    names = [i.split(" AS ")[-1] for i in _LEGACY_CUM] + ["sell_price_rel_diff", "sell_price_cumrel", "sell_price_roll_sd7"]
    return _rounded(out, names)
