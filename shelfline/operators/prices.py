"""Price features at weekly or daily grain."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from shelfline.functions.rolling import running
from shelfline.functions.scalars import ratio
from shelfline.lineage import cut
from shelfline.sources import retail

PRODUCT = ["store_id", "item_id"]


def with_price_per_day(series: DataFrame, prices: DataFrame) -> DataFrame:
    """Week code, month, year and the price of the week for every (series, day) row."""
    dated = series.withColumns(
        {"wm_yr_wk": retail.week_code("date"), "month": F.month("date"), "year": F.year("date")}
    )
    return dated.join(prices, [*PRODUCT, "wm_yr_wk"], "left")


def price_with_stats(df: DataFrame, price: str = "sell_price", product: Sequence[str] = PRODUCT) -> DataFrame:
    """Max, min, std, mean, share of max and distinct counts of the price.

    ``product`` names the (store, item) pair; where a series id stands for the pair, passing
    it keeps the partitioning the series already has. A pair holds at most one row per
    period, so a window over it is bounded. The number of items that share a price in a store
    is not; it is counted on the distinct prices and comes back as one small map per product,
    so the rows are not shuffled by price.
    """
    pair = Window.partitionBy(*product)
    top = F.max(price).over(pair)
    keys = list(dict.fromkeys([*product, *PRODUCT]))
    pairs = cut(df.filter(F.col(price).isNotNull()).select(*keys, price).distinct())
    sharing = pairs.groupBy("store_id", price).agg(F.countDistinct("item_id").alias("_n"))
    counts = (
        pairs.join(sharing, ["store_id", price])
        .groupBy(*product)
        .agg(F.map_from_entries(F.collect_list(F.struct(price, "_n"))).alias("_sharing"))
    )
    out = df.withColumns(
        {
            "price_max": top,
            "price_min": F.min(price).over(pair),
            "price_std": F.stddev_samp(price).over(pair),
            "price_mean": F.avg(price).over(pair),
            "price_norm": ratio(F.col(price), top),
        }
    ).join(counts, list(product), "left")
    return out.withColumns(
        {
            "price_nunique": F.coalesce(F.size("_sharing"), F.lit(0)).cast("bigint"),
            "item_nunique": F.try_element_at("_sharing", F.col(price)),
        }
    ).drop("_sharing")


def period_price_ratio(keys: Sequence[str], price: str = "sell_price") -> Column:
    """Price over the mean price of the same product and period."""
    return ratio(F.col(price), F.avg(price).over(Window.partitionBy(*keys)))


def price_momentum(price: str, w: WindowSpec) -> Column:
    return ratio(F.col(price), F.lag(price).over(w))


def price_range_position(price: str, w: WindowSpec) -> Column:
    """Where the price stands in its range so far."""
    low, high = running(price, "min", w), running(price, "max", w)
    return (F.col(price) - low) / (1 + high - low)
