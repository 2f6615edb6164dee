"""Series diagnostics: correlations, autocorrelation, decomposition."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from shelfline.functions.rolling import along
from shelfline.functions.dates import monday_zero
from shelfline.lineage import stage

#: Series that a task compares with the first one at once.
SERIES_AT_ONCE = 256


def lagged_correlation(df: DataFrame, key: str, day: str, value: str, max_lag: int) -> DataFrame:
    """Correlation of the first series (smallest key) with each other one at lags -L..L.

    Output (key, lag, r): r pairs the first series on a day with the other ``lag`` days earlier, over
    the days that both have; null where one of them does not vary. The first series is one value per calendar day
    and goes to all tasks; every other one is one short array, so a batch of series and a lag are
    a few matrix products, and no pair of days is ever a row. A lag without a common day gives no row.
    """
    df = stage(df.select(key, day, F.col(value).cast("double").alias(value)).where(F.col(value).isNotNull()), "lagged-series")
    ends = df.agg(F.min(key).alias("first"), F.min(day).alias("low"), F.max(day).alias("high")).first()
    kind = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, lag int, r double"
    if ends["first"] is None:
        return df.sparkSession.createDataFrame([], schema)
    place = F.datediff(day, F.lit(ends["low"]))
    days = (ends["high"] - ends["low"]).days + 1
    anchor, known = np.zeros(days), np.zeros(days)
    for r in df.where(F.col(key) == F.lit(ends["first"])).select(place.alias("i"), F.col(value).alias("v")).collect():
        anchor[r.i], known[r.i] = r.v, 1.0
    anchor = (anchor - anchor.sum() / known.sum()) * known
    series = df.where(F.col(key) != F.lit(ends["first"])).groupBy(key).agg(F.collect_list(place).alias("i"), F.collect_list(value).alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, SERIES_AT_ONCE):
                piece = batch.slice(start, SERIES_AT_ONCE)
                n = piece.num_rows
                row = np.repeat(np.arange(n), np.diff(piece.column("i").offsets.to_numpy()))
                y, there = np.zeros((n, days)), np.zeros((n, days))
                at = piece.column("i").flatten().to_numpy()
                y[row, at], there[row, at] = piece.column("v").flatten().to_numpy(), 1.0
                y = (y - (y.sum(1) / there.sum(1))[:, None]) * there
                lags, r, both = [], [], []
                for lag in range(-min(max_lag, days - 1), min(max_lag, days - 1) + 1):
                    x, own = (z[max(lag, 0) : days + min(lag, 0)] for z in (anchor, known))
                    v, m = (z[:, max(-lag, 0) : days + min(-lag, 0)] for z in (y, there))
                    count, sx, sy = m @ own, m @ x, v @ own
                    xx, yy, xy = m @ (x * x), (v * v) @ own, v @ x
                    vx, vy = count * xx - sx * sx, count * yy - sy * sy
                    varies = (vx > 1e-12 * count * xx) & (vy > 1e-12 * count * yy)
                    found = np.full(n, np.nan)
                    found[varies] = (count * xy - sx * sy)[varies] / np.sqrt(vx[varies] * vy[varies])
                    lags.append(np.full(n, lag, np.int32))
                    r.append(found)
                    both.append(count > 0)
                keep = np.concatenate(both)
                names = piece.column(key).take(pa.array(np.tile(np.arange(n), len(lags))[keep]))
                r_ = np.concatenate(r)[keep]
                yield pa.RecordBatch.from_arrays([names, pa.array(np.concatenate(lags)[keep]), pa.array(r_, mask=np.isnan(r_))], [key, "lag", "r"])

    return series.mapInArrow(run, schema)


def best_lags(correlations: DataFrame, key: str) -> DataFrame:
    """Largest and smallest correlation per series and the lag of each (first lag on ties)."""
    up = F.struct(F.col("r"), -F.col("lag"))
    down = F.struct(F.col("r"), F.col("lag"))
    return correlations.filter("r IS NOT NULL").groupBy(key).agg(
        F.max("r").alias("max_cross_corr"),
        F.min("r").alias("min_cross_corr"),
        F.max_by("lag", up).alias("offset_max"),
        F.min_by("lag", down).alias("offset_min"),
    )


def partners(df: DataFrame, group: str, key: str, day: str, value: str, threshold: float = 0.8) -> DataFrame:
    """Per series its most correlated partner of the same group: (key, partner, r, n_strong, n_partners).

    A group is an item, its series are the stores that sell it: one vector per store and calendar
    day, compared in one matrix product. ``n_strong`` counts partners whose absolute correlation
    exceeds ``threshold``; ties go to the smaller key, a series without variance has no partner.
    """
    vectors = df.groupBy(F.col(group).alias("group"), F.col(key).alias("id")).agg(
        F.expr(f"transform(sort_array(collect_list(struct({day}, {value}))), p -> p.{value})").alias("v")
    )

    def product(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", ignore_index=True)
        x = np.stack(pdf["v"].to_numpy()).astype(float)
        x = x - x.mean(axis=1, keepdims=True)
        norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
        live = norm[:, 0] > 0
        r = (x @ x.T) / np.where(live, norm[:, 0], 1.0) / np.where(live, norm, 1.0)
        usable = live[:, None] & live[None, :] & ~np.eye(len(x), dtype=bool)
        # Equal to nine digits is a tie.
        ranked = np.where(usable, np.round(np.abs(r), 9), -1.0)
        best = ranked.argmax(axis=1)
        found = usable.any(axis=1)
        ids = pdf["id"].to_numpy()
        return pd.DataFrame(
            {
                "id": ids,
                "partner": np.where(found, ids[best], None),
                "r": np.where(found, r[np.arange(len(x)), best], np.nan),
                "n_strong": (ranked > threshold).sum(axis=1),
                "n_partners": usable.sum(axis=1),
            }
        )

    out = vectors.groupBy("group").applyInPandas(product, "id string, partner string, r double, n_strong bigint, n_partners bigint")
    return out.withColumn("r", F.when(~F.isnan("r"), F.col("r")))


def autocorrelation(df: DataFrame, key: str, day: str, value: str, lags: int) -> DataFrame:
    """Autocorrelation of every series at lags 1..L: (key, lag, acf); null for a constant series.

    The products x(t)x(t-k) are summed per series with plain lag expressions, one pass over
    rows that already sit together by series.
    """
    w = along(key, day)
    mean = F.avg(value).over(Window.partitionBy(key))
    centred = df.select(key, day, (F.col(value) - mean).alias("_c"))
    products = centred.select(
        key,
        (F.col("_c") * F.col("_c")).alias("_p0"),
        *[(F.col("_c") * F.lag("_c", k).over(w)).alias(f"_p{k}") for k in range(1, lags + 1)],
    )
    sums = products.groupBy(key).agg(*[F.sum(f"_p{k}").alias(f"_p{k}") for k in range(lags + 1)])
    entries = [F.struct(F.lit(k).alias("lag"), F.try_divide(F.col(f"_p{k}"), F.col("_p0")).alias("acf")) for k in range(1, lags + 1)]
    return sums.select(key, F.explode(F.array(*entries)).alias("e")).select(key, "e.lag", "e.acf")


def best_autocorrelation(acf: DataFrame, key: str) -> DataFrame:
    """Largest autocorrelation per series and its lag (smallest lag on ties)."""
    return acf.filter("acf IS NOT NULL").groupBy(key).agg(
        F.max("acf").alias("max_autocorr"), F.max_by("lag", F.struct(F.col("acf"), -F.col("lag"))).alias("argmax_autocorr")
    )


def partial_autocorrelation(acf: DataFrame, key: str) -> DataFrame:
    """Partial autocorrelation from the autocorrelations by the Durbin-Levinson recursion.

    One short vector per series; a series without variance gives nulls.
    """
    rows = acf.groupBy(key).agg(F.expr("transform(sort_array(collect_list(struct(lag, acf))), p -> p.acf)").alias("rho"))

    def recursion(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            rho = np.stack([np.asarray(v, dtype=float) for v in pdf["rho"]])
            n, lags = rho.shape
            phi = np.zeros((n, lags))
            out = np.zeros((n, lags))
            with np.errstate(invalid="ignore", divide="ignore"):
                for k in range(lags):
                    top = rho[:, k] - (phi[:, :k] * rho[:, :k][:, ::-1]).sum(axis=1)
                    low = 1.0 - (phi[:, :k] * rho[:, :k]).sum(axis=1)
                    last = top / low
                    phi[:, :k] = phi[:, :k] - last[:, None] * phi[:, :k][:, ::-1]
                    phi[:, k] = last
                    out[:, k] = last
            yield pd.DataFrame(
                {
                    key: np.repeat(pdf[key].to_numpy(), lags),
                    "lag": np.tile(np.arange(1, lags + 1, dtype=np.int32), n),
                    "pacf": out.ravel(),
                }
            )

    out = rows.mapInPandas(recursion, f"{key} string, lag int, pacf double")
    return out.withColumn("pacf", F.when(~F.isnan("pacf"), F.col("pacf")))


def decompose(df: DataFrame, key: str, day: str, value: str) -> DataFrame:
    """Additive split: centred 7-row mean, weekday mean of the rest, residual."""
    w = along(key, day)
    centred = w.rowsBetween(-3, 3)
    x = F.col(value)
    trend = F.when(F.count(x).over(centred) == 7, F.avg(x).over(centred))
    out = df.select(key, day, value, trend.alias("trend"))
    by_weekday = Window.partitionBy(key, monday_zero(day))
    out = out.withColumn("seasonality", F.avg(x - F.col("trend")).over(by_weekday))
    return out.withColumn("residual", x - F.col("trend") - F.col("seasonality"))
