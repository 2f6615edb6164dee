"""Query registry and the SQL texts shared by the DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


LINES = """
lines AS (
  SELECT p_brand, p_type, n_name, r_name, CAST(l_shipdate AS DATE) AS date,
         CAST(l_quantity AS BIGINT) AS qty, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents
  FROM lineitem JOIN part ON l_partkey = p_partkey
  JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey
)"""

CAL = """
cal_days AS (
  SELECT CAST(DATE '1995-01-02' + CAST(n - 1 AS INTEGER) AS DATE) AS date, CAST(n AS INTEGER) AS dn
  FROM range(1, 2528) t(n)
),
cal AS (
  SELECT date, dn, CAST(floor((dn - 1) / 7.0) + 1 AS INTEGER) AS wm_yr_wk, dayname(date) AS weekday,
         CAST(dayofweek(date) + 1 AS INTEGER) AS wday,
         CAST(month(date) AS INTEGER) AS month, CAST(year(date) AS INTEGER) AS year, 'd_' || dn AS d,
         CASE strftime(date, '%m-%d') WHEN '01-01' THEN 'NewYear' WHEN '02-14' THEN 'ValentinesDay'
              WHEN '07-04' THEN 'IndependenceDay' WHEN '10-31' THEN 'Halloween' WHEN '12-25' THEN 'Christmas' END AS event_name_1,
         CASE strftime(date, '%m-%d') WHEN '01-01' THEN 'National' WHEN '02-14' THEN 'Cultural'
              WHEN '07-04' THEN 'National' WHEN '10-31' THEN 'Cultural' WHEN '12-25' THEN 'National' END AS event_type_1,
         CASE strftime(date, '%m-%d') WHEN '01-01' THEN 'Bowl' WHEN '10-31' THEN 'Harvest' END AS event_name_2,
         CASE strftime(date, '%m-%d') WHEN '01-01' THEN 'Sporting' WHEN '10-31' THEN 'Cultural' END AS event_type_2,
         CAST(day(date) IN (1,2,3,4,5,6,7,8,9,10) AS INTEGER) AS "snap_CA",
         CAST(day(date) IN (1,3,5,6,7,9,11,12,13,15) AS INTEGER) AS "snap_TX",
         CAST(day(date) IN (2,3,5,6,8,9,11,12,14,15) AS INTEGER) AS "snap_WI"
  FROM cal_days
)"""

DAILY_SOLD = (
    LINES
    + """,
sold AS (
  SELECT p_brand || '_' || r_name AS id, p_brand AS item_id, substr(p_brand, 1, 7) AS dept_id,
         CASE WHEN CAST(regexp_extract(p_brand, '(\\d+)$', 1) AS INTEGER) <= 12 THEN 'LOW' ELSE 'HIGH' END AS cat_id,
         r_name AS store_id,
         CASE r_name WHEN 'AMERICA' THEN 'AMER' WHEN 'ASIA' THEN 'APAC' ELSE 'EMEA' END AS state_id,
         date, CAST(sum(qty) AS DOUBLE) AS demand, CAST(sum(cents) AS BIGINT) AS cents
  FROM lines GROUP BY ALL
),
ids AS (SELECT DISTINCT id, item_id, dept_id, cat_id, store_id, state_id FROM sold)"""
)

PRICES = """
prices AS (
  SELECT store_id, item_id, CAST(floor(date_diff('day', DATE '1995-01-02', date) / 7.0) + 1 AS INTEGER) AS wm_yr_wk,
         (sum(cents) // CAST(sum(demand) AS BIGINT)) / 100.0::DOUBLE AS sell_price
  FROM sold GROUP BY ALL
)"""

DAILY = (
    "WITH "
    + DAILY_SOLD
    + ","
    + CAL
    + ","
    + PRICES
    + """,
daily AS (
  SELECT ids.*, cal.date, coalesce(sold.demand, 0) AS demand
  FROM ids CROSS JOIN cal LEFT JOIN sold ON sold.id = ids.id AND sold.date = cal.date
  WHERE cal.dn <= 2499
)"""
)

WEEKLY_SOLD = (
    LINES
    + """,
sold AS (
  SELECT p_type || '/' || p_brand || '_' || n_name AS id, p_type || '/' || p_brand AS item_id, p_brand AS dept_id,
         p_type AS cat_id, n_name AS store_id, r_name AS state_id, CAST(date_trunc('week', date) AS DATE) AS date,
         CAST(sum(qty) AS DOUBLE) AS demand, CAST(sum(cents) AS BIGINT) AS cents
  FROM lines GROUP BY ALL
),
ids AS (SELECT DISTINCT id, item_id, dept_id, cat_id, store_id, state_id FROM sold)"""
)

WEEKLY = (
    "WITH "
    + WEEKLY_SOLD
    + ","
    + PRICES
    + """,
weeks AS (SELECT CAST(DATE '1995-01-02' + CAST(7 * (n - 1) AS INTEGER) AS DATE) AS date, CAST(n AS INTEGER) AS wk FROM range(1, 358) t(n)),
weekly AS (
  SELECT ids.*, weeks.date, weeks.wk, coalesce(sold.demand, 0) AS demand
  FROM ids CROSS JOIN weeks LEFT JOIN sold ON sold.id = ids.id AND sold.date = weeks.date
)"""
)

#: Continues DAILY: stores of one item, compared day by day.
PARTNERS = """, pairs AS (SELECT a.id, b.id AS partner, corr(a.demand, b.demand) AS r
  FROM daily a JOIN daily b ON a.item_id = b.item_id AND a.date = b.date AND a.id <> b.id GROUP BY ALL),
best AS (SELECT id, partner, r, abs(r) > 0.8 AS strong, row_number() OVER (PARTITION BY id ORDER BY round(abs(r), 9) DESC, partner) AS rank FROM pairs)
"""
