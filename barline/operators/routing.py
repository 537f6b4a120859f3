"""Feeds: routing of bars to subscribers, overload policies, counters and change events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barline.functions import scalars as S

EVENTS = ["sbar_created", "cbar_changed", "swing_changed", "trend_changed", "timeframe_end", "bar_appended"]


def route(bars: DataFrame, subscriptions: DataFrame, interval_seconds: int) -> DataFrame:
    """(subscriber, bar) for every subscription(subscriber, channel) to a bar's channel; others go nowhere."""
    return bars.withColumn("channel", S.channel_key("symbol", F.lit(interval_seconds))).join(subscriptions, "channel")


def active_channels(subscriptions: DataFrame) -> DataFrame:
    return subscriptions.groupBy("channel").agg(F.count("*").alias("subscribers"))


def new_subscriptions(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """Wanted channels that aren't subscribed yet."""
    return wanted.select("channel").distinct().join(known, "channel", "left_anti")


def channels_with_receivers(channels: DataFrame, subscriptions: DataFrame) -> DataFrame:
    return channels.join(subscriptions, "channel", "left_semi")


def ring(rows: DataFrame, keys: list[str], order: str, capacity: int, policy: str = "drop_oldest") -> DataFrame:
    """What a ring of `capacity` holds of each key's rows: the newest (drop_oldest) or the first (drop_newest)."""
    at = F.desc(order) if policy == "drop_oldest" else F.asc(order)
    return rows.withColumn("_place", F.row_number().over(W.partitionBy(*keys).orderBy(at))).where(F.col("_place") <= capacity).drop("_place")


def ring_counters(rows: DataFrame, keys: list[str], capacity: int, policy: str = "drop_oldest") -> DataFrame:
    """Published and dropped rows of each key; all published rows are delivered, drops concern the ring alone."""
    n = F.count("*")
    dropped = F.greatest(n - capacity, F.lit(0).cast("long"))
    none = F.lit(0).cast("long")
    old, new = (dropped, none) if policy == "drop_oldest" else (none, dropped)
    return rows.groupBy(*keys).agg(n.alias("published"), dropped.alias("dropped"), old.alias("dropped_oldest"), new.alias("dropped_newest"), F.least(n, F.lit(capacity).cast("long")).alias("ring_len"))


def change_events(bars: DataFrame) -> DataFrame:
    """The six notifications of each appended bar, in their order."""
    events = F.posexplode(F.array(*[F.lit(e) for e in EVENTS])).alias("event_order", "event_type")
    return bars.select("symbol", "exchange", "timeframe", F.col("id").alias("sbar_id"), events)
