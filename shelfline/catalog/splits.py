"""Splits and folds."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from shelfline.catalog.base import DAILY, query
from shelfline.operators import folds
from shelfline.plans.grain import hold_out
from shelfline.sources import files, retail


def _hash(seed: int, key: str) -> str:
    return f"('0x' || substr(md5('{seed}|' || {key}), 1, 8))::BIGINT"


@query(
    "k01_hold_out",
    DAILY
    + """SELECT 'target' AS part, id, date, demand FROM daily WHERE date <= DATE '2001-10-07'
UNION ALL SELECT 'truth', id, date, demand FROM daily WHERE date > DATE '2001-10-07'""",
)
def hold_out_split(spark, sf):
    tables = hold_out(retail.daily_series(spark, sf), date(2001, 10, 7))
    return tables["target"].select(F.lit("target").alias("part"), "*").unionByName(
        tables["truth"].select(F.lit("truth").alias("part"), "*")
    )


@query(
    "k02_day_slices",
    DAILY
    + """SELECT id, date, 'train' AS role FROM daily JOIN cal USING (date) WHERE dn BETWEEN 1200 AND 2471
UNION ALL SELECT id, date, 'test' FROM daily JOIN cal USING (date) WHERE dn BETWEEN 2471 - 57 AND 2471 + 28""",
)
def day_slices(spark, sf):
    df = retail.daily_series(spark, sf).select("id", "date")
    return folds.day_slices(df, retail.day_number("date"), 1200, 2471, 57, 28)


def _sliding_sql(n: int, train: int, test: int) -> str:
    parts = []
    for i in range(n):
        shift = (n - 1 - i) * test / 2
        start, middle = shift + test + train, shift + test
        parts.append(f"SELECT o_orderkey, {i} AS fold, 'train' AS role FROM b WHERE back <= {start} AND back > {middle}")
        end = "" if i == n - 1 else f" AND back > {shift}"
        parts.append(f"SELECT o_orderkey, {i}, 'test' FROM b WHERE back <= {middle}{end}")
    return (
        "WITH b AS (SELECT o_orderkey, date_diff('day', o_orderdate, (SELECT max(o_orderdate) FROM orders)) AS back FROM orders)\n"
        + " UNION ALL ".join(parts)
    )


@query("k03_sliding_time_folds", _sliding_sql(5, 80, 20))
def sliding_time_folds(spark, sf):
    df = files.table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("d"))
    return folds.sliding_time_folds(df, "d", 5, 80, 20).drop("d")


@query("k03_single_time_fold", _sliding_sql(1, 365, 28))
def single_time_fold(spark, sf):
    df = files.table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("d"))
    return folds.sliding_time_folds(df, "d", 1, 365, 28).drop("d")


def _backtest_sql(n: int, train: int, test: int) -> str:
    parts = []
    for i in range(n):
        ahead = (n - i - 1) * test
        parts.append(f"SELECT o_orderkey, {i} AS fold, 'train' AS role FROM b WHERE pos BETWEEN {ahead + test} AND {ahead + test + train - 1}")
        parts.append(f"SELECT o_orderkey, {i}, 'test' FROM b WHERE pos BETWEEN {ahead} AND {ahead + test - 1}")
    return (
        "WITH b AS (SELECT o_orderkey, dense_rank() OVER (ORDER BY o_orderdate DESC) - 1 AS pos FROM orders)\n" + " UNION ALL ".join(parts)
    )


@query("k04_backtest_folds", _backtest_sql(3, 365, 28))
def backtest_folds(spark, sf):
    df = files.table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("d"))
    return folds.backtest_folds(df, "d", 3, 365, 28).drop("d")


@query(
    "k05_random_folds",
    " UNION ALL ".join(
        f"SELECT o_orderkey, {seed} AS mc_seed, CAST({i * 5} + {_hash(seed, 'o_orderkey')} % 5 AS INTEGER) AS fold FROM orders"
        for i, seed in enumerate((11, 23))
    ),
)
def random_folds(spark, sf):
    return folds.random_folds(files.table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 5, (11, 23))


@query(
    "k06_stratified_folds",
    f"""SELECT o_orderkey, o_orderstatus, CAST((row_number() OVER (PARTITION BY o_orderstatus ORDER BY {_hash(7, 'o_orderkey')}, o_orderkey) - 1) % 5 AS INTEGER) AS fold FROM orders""",
)
def stratified_folds(spark, sf):
    df = files.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return folds.stratified_folds(df, "o_orderkey", "o_orderstatus", 5, 7)


@query(
    "k07_group_folds",
    """WITH g AS (SELECT o_custkey, row_number() OVER (ORDER BY count(*) DESC, o_custkey) - 1 AS pos FROM orders GROUP BY 1)
SELECT o_orderkey, o_custkey, CAST(CASE WHEN (pos // 5) % 2 = 0 THEN pos % 5 ELSE 4 - pos % 5 END AS INTEGER) AS fold FROM orders JOIN g USING (o_custkey)""",
)
def group_folds(spark, sf):
    df = files.table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return folds.group_folds(df, "o_custkey", 5)


@query(
    "k08_rolling_row_folds",
    """WITH p AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS pos, count(*) OVER () AS n FROM events),
f AS (SELECT CAST(f AS INTEGER) AS fold FROM range(0, (SELECT (max(n) - 3000) // 700 FROM p)) t(f))
SELECT event_id, fold, 'train' AS role FROM p JOIN f ON pos >= fold * 700 AND pos < fold * 700 + 3000
UNION ALL SELECT event_id, fold, 'test' FROM p JOIN f ON pos >= fold * 700 + 3000 AND pos < fold * 700 + 3700""",
)
def rolling_row_folds(spark, sf):
    df = files.table(spark, sf, "events").select("event_id", "ts")
    return folds.rolling_row_folds(df, ["ts", "event_id"], 3000, 700).drop("ts")


@query(
    "k09_evaluation_split",
    f"""WITH r AS (SELECT *, count(*) OVER () AS n, row_number() OVER (ORDER BY {_hash(3, 'o_orderkey')}, o_orderkey) AS a,
row_number() OVER (PARTITION BY o_orderstatus ORDER BY {_hash(3, 'o_orderkey')}, o_orderkey) AS s, count(*) OVER (PARTITION BY o_orderstatus) AS ns,
row_number() OVER (ORDER BY o_orderkey) AS p FROM orders)
SELECT o_orderkey, 'random' AS how, a <= round(n * 0.2) AS is_validation FROM r
UNION ALL SELECT o_orderkey, 'stratified', s <= round(ns * 0.2) FROM r
UNION ALL SELECT o_orderkey, 'date', o_orderdate > DATE '2001-01-01' FROM r
UNION ALL SELECT o_orderkey, 'first', p > floor(n * 0.2) FROM r""",
)
def evaluation_split(spark, sf):
    df = files.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", F.col("o_orderdate").cast("date").alias("d"))
    out = None
    for how in ("random", "stratified", "date", "first"):
        part = folds.evaluation_split(
            df, how, "o_orderkey", 0.2, 3, label="o_orderstatus", day="d", start=date(2001, 1, 1)
        ).select("o_orderkey", F.lit(how).alias("how"), "is_validation")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "k10_fixed_sample",
    f"SELECT event_id, row_number() OVER (ORDER BY {_hash(42, 'event_id')}, event_id) <= 2000 AS in_sample FROM events",
)
def fixed_sample(spark, sf):
    return folds.fixed_sample(files.table(spark, sf, "events").select("event_id"), "event_id", 2000, 42)
