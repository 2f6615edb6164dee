"""Base grain: one row per series and day with calendar, price, release and shifted target."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfline.functions.rolling import along
from shelfline.operators.clean import trim_before_release
from shelfline.operators.reshape import add_horizon
from shelfline.sources import retail


def base_grain(
    spark: SparkSession, sf_dir: str, shift: int | None = None, horizon: int = 0, sold: DataFrame | None = None
) -> DataFrame:
    """Long sales with calendar and price, trimmed before release.

    ``shift`` adds the target moved that many days and drops rows without it; without it the
    shifted target is the target itself. ``horizon`` appends future days with a null target.
    """
    sold = retail.staged_daily_sold(spark, sf_dir) if sold is None else sold
    sales = retail.daily_series(spark, sf_dir, sold)
    if horizon:
        sales = add_horizon(sales, retail.IDS, retail.SPAN_END, horizon)
    prices = retail.prices_of(sold)
    # The calendar has one row per day: small by construction.
    df = sales.join(F.broadcast(retail.calendar(spark, sold=sold)), "date", "left")
    df = df.join(prices, ["store_id", "item_id", "wm_yr_wk"], "left")
    df = trim_before_release(df, prices)
    if shift is None:
        return df.withColumn("shifted_demand", F.col("demand"))
    moved = df.withColumn("shifted_demand", F.lag("demand", shift).over(along("id", "date")))
    return moved.filter("shifted_demand IS NOT NULL")


def hold_out(df: DataFrame, split: date, target: str = "demand") -> dict[str, DataFrame]:
    """Train and test features without the target, with the target and truth tables beside."""
    early, late = df.filter(F.col("date") <= F.lit(split)), df.filter(F.col("date") > F.lit(split))
    keys = ["id", "date", target]
    return {
        "train": early.drop(target),
        "target": early.select(*keys),
        "test": late.drop(target),
        "truth": late.select(*keys),
    }
