"""Ticks to bars, bars to coarser bars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barline.functions import scalars as S

SERIES = ["symbol", "exchange"]


def tick_deltas(ticks: DataFrame) -> DataFrame:
    """ticks with volume and turnover since the tick before, per symbol and exchange; ordered by datetime and event_id."""
    w = W.partitionBy(*SERIES).orderBy("datetime", "event_id")
    for c in ("volume", "turnover"):
        ticks = ticks.withColumn(f"{c}_delta", S.counter_delta(c, F.lag(c).over(w)))
    return ticks


def tick_to_m1(ticks: DataFrame, flush: bool = True) -> DataFrame:
    """Minute bars. A bar closes whenever the minute changes, so a late tick opens a second bar of an old minute.

    Null prices are dropped. flush: also the bar that is still open at the end of each series.
    """
    w = W.partitionBy(*SERIES).orderBy("datetime", "event_id")
    rows = tick_deltas(ticks.where(F.col("last_price").isNotNull() & ~F.isnan("last_price")))
    rows = rows.withColumn("minute", F.date_trunc("minute", "datetime"))
    change = F.coalesce((F.col("minute") != F.lag("minute").over(w)).cast("int"), F.lit(0))
    rows = rows.withColumn("change", change).withColumn("island", F.sum("change").over(w))
    order = F.struct("datetime", "event_id")
    bars = rows.groupBy(*SERIES, "island").agg(
        F.min("minute").alias("datetime"),
        F.min_by("last_price", order).alias("open_price"),
        F.max("last_price").alias("high_price"),
        F.min("last_price").alias("low_price"),
        F.max_by("last_price", order).alias("close_price"),
        F.sum("volume_delta").alias("volume"),
        F.max_by("open_interest", order).alias("open_interest"),
        F.sum("turnover_delta").alias("turnover"),
    )
    if not flush:
        bars = bars.withColumn("last", F.max("island").over(W.partitionBy(*SERIES))).where("island < last").drop("last")
    return bars.select(*SERIES, F.lit("m1").alias("timeframe"), (F.col("island") + 1).alias("id"), *BAR[3:])


BAR = ["symbol", "exchange", "timeframe", "datetime", "open_price", "high_price", "low_price", "close_price", "volume", "open_interest", "turnover"]


def _merge(groups, order: str = "id") -> DataFrame:
    return groups.agg(
        F.count("*").alias("n"),
        F.max_by("datetime", order).alias("datetime"),
        F.min_by("open_price", order).alias("open_price"),
        F.max("high_price").alias("high_price"),
        F.min("low_price").alias("low_price"),
        F.max_by("close_price", order).alias("close_price"),
        F.sum("volume").alias("volume"),
        F.max_by("open_interest", order).alias("open_interest"),
        F.sum("turnover").alias("turnover"),
    )


def count_window(m1: DataFrame, label: str) -> DataFrame:
    """Bars of every n minute bars by count, not by clock; the last bar's time; an incomplete tail gives none."""
    n = S.MINUTES[label]
    if n == 1:
        return m1
    group = F.floor((F.col("id") - 1) / n)
    out = _merge(m1.groupBy(*SERIES, group.alias("group"))).where(F.col("n") == n)
    return out.select(*SERIES, F.lit(label).alias("timeframe"), (F.col("group") + 1).alias("id"), *BAR[3:])


def fan_out(m1: DataFrame, labels: list[str]) -> DataFrame:
    """The bars of all registered timeframes; minute bars only if m1 is registered."""
    parts = [count_window(m1, S.ALIASES[x.strip().lower()]) for x in dict.fromkeys(labels)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def clock_bars(ticks: DataFrame, unit: str, label: str) -> DataFrame:
    """Bars aligned to the clock (unit as for date_trunc), numbered from 1 in each series; volume counts ticks."""
    order = F.struct("datetime", "event_id")
    bars = ticks.groupBy(*SERIES, F.date_trunc(unit, "datetime").alias("at")).agg(
        F.min_by("last_price", order).alias("open_price"),
        F.max("last_price").alias("high_price"),
        F.min("last_price").alias("low_price"),
        F.max_by("last_price", order).alias("close_price"),
        F.count("*").cast("double").alias("volume"),
        F.max_by("open_interest", order).alias("open_interest"),
        (F.sum(F.round(F.col("last_price") * 100).cast("long")) / 100.0).alias("turnover"),
    )
    bars = bars.withColumn("id", F.row_number().over(W.partitionBy(*SERIES).orderBy("at")).cast("long"))
    return bars.select(*SERIES, F.lit(label).alias("timeframe"), "id", F.col("at").alias("datetime"), *BAR[4:])


def shape(bars: DataFrame) -> DataFrame:
    """bars with body, shadows and range."""
    return bars.select("*", S.body().alias("body"), S.upper_shadow().alias("upper_shadow"), S.lower_shadow().alias("lower_shadow"), S.total_range().alias("total_range"))


def last_n(rows: DataFrame, keys: list[str], n: int, order: str = "id") -> DataFrame:
    """The n last rows of each series, in no order."""
    place = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(order)))
    return rows.withColumn("place", place).where(F.col("place") <= n).drop("place")


def keep_registered(bars: DataFrame, labels: list[str]) -> DataFrame:
    """Bars of timeframes that aren't registered are ignored."""
    return bars.where(F.col("timeframe").isin(*labels))
