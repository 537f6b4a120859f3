"""Key price zones from segments (swings, trends), and how bars react to them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barline.functions import scalars as S

KEYS = ["symbol", "exchange", "timeframe"]
ZONE = [*KEYS, "zone_id"]


def tick_sizes(scope: DataFrame, keys: list[str]) -> DataFrame:
    """A tenth of the smallest step over 1e-9 within the bars of each group, 1e-4 at least; 0.2 if there is none."""
    steps = [S.total_range(), S.body(), F.abs(F.col("high_price") - F.col("open_price")), F.abs(F.col("low_price") - F.col("open_price"))]
    least = F.least(*[F.when(F.abs(s) > 1e-9, F.abs(s)) for s in steps])
    return scope.groupBy(*keys).agg(F.when(F.min(least).isNull(), 0.2).otherwise(F.greatest(F.min(least) / 10, F.lit(1e-4))).alias("tick"))


def candidates(segments: DataFrame, origin: str, newest: int = 5) -> DataFrame:
    """The newest segments of each series, newest first, as zones that aren't refined yet."""
    place = F.row_number().over(W.partitionBy(*KEYS).orderBy(F.desc("id")))
    cols = [*KEYS, F.lit(origin).alias("origin_type"), F.col("place").cast("int").alias("place"), "direction", "sbar_start_id", "sbar_end_id", "high_price", "low_price"]
    return segments.withColumn("place", place).where(F.col("place") <= newest).select(*cols)


def zones(swing_rows: DataFrame, trend_rows: DataFrame | None, bars: DataFrame, newest: int = 5, scope_bars: int = 200) -> DataFrame:
    """Refined zones of each series, from the newest swings, then the newest trends, over the last scope_bars bars."""
    found = candidates(swing_rows, "swing", newest)
    if trend_rows is not None:
        found = found.unionByName(candidates(trend_rows, "trend", newest))
    order = W.partitionBy(*KEYS).orderBy("origin_type", "place")
    # at most 2 * newest rows a series, used several times below, and costly where the segments come from folds
    found = found.withColumn("zone_id", F.row_number().over(order).cast("int")).drop("place").persist()
    place = F.row_number().over(W.partitionBy(*KEYS).orderBy(F.desc("id")))
    recent = bars.withColumn("place", place).where(F.col("place") <= scope_bars).drop("place")
    return refine(found, recent)


def refine(found: DataFrame, bars: DataFrame) -> DataFrame:
    """Zones (zone_id, direction, sbar_start_id, sbar_end_id, high_price, low_price) with bounds, touches and last touch.

    An up zone lies below the highest price, a down zone above the lowest; the other bound is the price on a grid of
    ticks that most bars touch (of equals the one nearest to the start of the grid). Only grid points from which the
    count can rise are tried: the first, and the first at or above each bar's low. Without bars in the zone the segment's
    own prices stand, with no touch.
    """
    number = F.explode(F.sequence("sbar_start_id", "sbar_end_id")).alias("id")
    scope = found.select(*ZONE, "direction", number).join(bars, [*KEYS, "id"])
    top, bottom = F.greatest("open_price", "close_price"), F.least("open_price", "close_price")
    facts = scope.groupBy(*ZONE).agg(
        F.max("high_price").alias("highest"),
        F.min("low_price").alias("lowest"),
        F.min(top).alias("least_top"),
        F.max(bottom).alias("most_bottom"),
        F.count("*").cast("int").alias("n_bars"),
        F.max("id").alias("last_touch_id"),
    )
    z = found.join(facts, ZONE, "left").join(tick_sizes(scope, ZONE), ZONE, "left")
    d = F.col("direction")
    z = z.withColumns(
        {
            "grid_from": F.when(d == 1, F.col("least_top")).when(d == -1, F.col("lowest")).otherwise(F.col("low_price")),
            "grid_to": F.when(d == 1, F.col("highest")).when(d == -1, F.col("most_bottom")).otherwise(F.col("high_price")),
        }
    )
    grid = z.where("n_bars > 0 and grid_to > grid_from").select(*ZONE, "grid_from", "grid_to", "tick")
    lows = scope.select(*ZONE, "low_price", "high_price")
    step = F.greatest(F.ceil((F.col("low_price") - F.col("grid_from")) / F.col("tick")), F.lit(0).cast("long"))
    starts = grid.join(lows, ZONE).select(*ZONE, "grid_from", "grid_to", "tick", step.alias("k")).distinct()
    starts = starts.unionByName(grid.select("*", F.lit(0).cast("long").alias("k"))).distinct()
    price = F.col("grid_from") + F.col("k") * F.col("tick")
    points = starts.withColumn("price", price).where(F.col("price") <= F.col("grid_to") + F.col("tick") * 0.5)
    touched = points.select(*ZONE, "k", "price").join(lows, ZONE).where("low_price <= price and price <= high_price")
    counts = touched.groupBy(*ZONE, "k").agg(F.count("*").cast("int").alias("touches"), F.min("price").alias("price"))
    best = counts.groupBy(*ZONE).agg(F.max_by(F.struct("touches", "price"), F.struct("touches", -F.col("k"))).alias("best"))
    z = z.join(best, ZONE, "left")
    flat = F.col("n_bars") > 0
    point = F.coalesce(F.col("best.price"), F.col("grid_from"))
    scanned = flat & (F.col("grid_to") > F.col("grid_from"))
    low = F.when(scanned & (d == 1), point).when(flat & (d == -1), F.col("lowest")).otherwise(F.col("low_price"))
    high = F.when(flat & (d == 1), F.col("highest")).when(scanned & (d == -1), point).otherwise(F.col("high_price"))
    touches = F.when(~F.coalesce(flat, F.lit(False)), 0).when(scanned, F.greatest(F.coalesce(F.col("best.touches"), F.lit(0)), F.lit(1))).otherwise(F.col("n_bars"))
    keep = [c for c in ("origin_type",) if c in found.columns]
    return z.select(*ZONE, *keep, "direction", F.least(low, high).alias("lower"), F.greatest(low, high).alias("upper"), touches.cast("int").alias("touch_count"), "last_touch_id", "sbar_start_id", "sbar_end_id")


def reactions(zone_rows: DataFrame, bars: DataFrame) -> DataFrame:
    """(zone_id, behavior, direction, strength, sbar_id) of each zone that a bar with its predecessor reacts to.

    bars: one row for each bar to judge, with prev_close, prev_high and prev_low (null without a predecessor). The bar must
    share more than an edge with the zone. A failed breakout comes before a second push, that before acceptance,
    that before rejection.
    """
    j = zone_rows.join(bars.withColumnRenamed("id", "sbar_id"), KEYS)
    c, d = F.col, F.col("direction")
    shared = F.least("high_price", "upper") - F.greatest("low_price", "lower")
    span = F.greatest(c("upper") - c("lower"), F.lit(1e-6))
    j = j.where(F.least("high_price", "upper") > F.greatest("low_price", "lower"))
    j = j.withColumns({"overlap": S.clamp(shared / span, 0, 1), "body": S.clamp(S.body() / F.greatest(S.total_range(), F.lit(1e-6)), 0, 1)})
    inside = S.zone_contains("close_price")
    across = F.when(d == 1, c("close_price") < c("lower")).when(d == -1, c("close_price") > c("upper")).otherwise(~inside)
    along = F.when(d == 1, c("close_price") >= c("open_price")).when(d == -1, c("close_price") <= c("open_price")).otherwise(True)
    broke = F.coalesce(F.when(d == 1, c("prev_close") > c("upper")).when(d == -1, c("prev_close") < c("lower")), F.lit(False))
    touched = F.coalesce((c("prev_low") <= c("upper")) & (c("prev_high") >= c("lower")), F.lit(False))
    cases = [
        (broke & inside, "breakout_failure", 0.65 + 0.35 * c("overlap")),
        (touched & (c("touch_count") >= 2) & along, "second_push", 0.55 + 0.45 * c("body")),
        (inside & along & (c("overlap") >= 0.55) & (c("body") >= 0.45), "strong_accept", 0.4 * c("overlap") + 0.6 * c("body")),
        (inside & along, "weak_accept", 0.4 * c("overlap") + 0.6 * c("body")),
        (across | (~along & (c("body") >= 0.45)), "strong_reject", 0.5 * c("overlap") + 0.5 * c("body")),
        (~along, "weak_reject", 0.5 * c("overlap") + 0.5 * c("body")),
    ]
    behavior, strength = F.when(cases[0][0], cases[0][1]), F.when(cases[0][0], cases[0][2])
    for on, name, value in cases[1:]:
        behavior, strength = behavior.when(on, name), strength.when(on, value)
    out = j.withColumns({"behavior": behavior, "strength": S.clamp(strength, 0, 1)}).where("behavior is not null")
    return out.select(*ZONE, "behavior", "direction", "strength", "sbar_id")


def reaction_state(behavior: str = "behavior"):
    return F.when(F.col(behavior).isin("strong_accept", "weak_accept", "second_push"), "accept").otherwise("reject")


def latest_bars(bars: DataFrame) -> DataFrame:
    """The last bar of each series with its predecessor's prices, as reactions() takes it."""
    w = W.partitionBy(*KEYS).orderBy("id")
    cols = {f"prev_{x}": F.lag(f"{x}_price").over(w) for x in ("close", "high", "low")}
    rows = bars.withColumns(cols)
    rest = [c for c in rows.columns if c not in KEYS]
    return rows.groupBy(*KEYS).agg(F.max_by(F.struct(*rest), "id").alias("x")).select(*KEYS, "x.*")


def best(signals: DataFrame) -> DataFrame:
    """The strongest signal of each series; of equals that of the first zone."""
    rest = [c for c in signals.columns if c not in KEYS]
    order = F.struct("strength", -F.col("zone_id"))
    out = signals.groupBy(*KEYS).agg(F.max_by(F.struct(*rest), order).alias("x")).select(*KEYS, "x.*")
    return out.withColumn("signed_strength", S.signed_strength())


#: Builders of raw zones by origin; registering an origin again replaces its builder.
BUILDERS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def register_builder(origin: str, build: Callable[[DataFrame], DataFrame]) -> None:
    BUILDERS[origin] = build


def raw_zones(segments: DataFrame, origin: str, newest: int = 5) -> DataFrame:
    """The newest segments as zones with their own prices, oldest first."""
    rows = candidates(segments, origin, newest)
    place = F.row_number().over(W.partitionBy(*KEYS).orderBy(F.desc("place"))).cast("int")
    return rows.select(*KEYS, place.alias("zone_id"), "origin_type", "direction", F.col("low_price").alias("lower"), F.col("high_price").alias("upper"), F.lit(0).alias("touch_count"), "sbar_start_id", "sbar_end_id")


def _channel(segments: DataFrame) -> DataFrame:
    zero = F.lit(0.0)
    rows = segments.select(*KEYS).distinct()
    return rows.select(*KEYS, F.lit(1).alias("zone_id"), F.lit("channel").alias("origin_type"), F.lit(0).alias("direction"), zero.alias("lower"), zero.alias("upper"), F.lit(0).alias("touch_count"), F.lit(0).cast("long").alias("sbar_start_id"), F.lit(0).cast("long").alias("sbar_end_id"))


register_builder("swing", lambda s: raw_zones(s, "swing"))
register_builder("trend", lambda s: raw_zones(s, "trend"))
register_builder("channel", _channel)
