"""Snapshots over timeframes and the trade decision."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barline.functions import scalars as S


def snapshot(rows: DataFrame, labels: dict[str, str], columns: list[str], order: str = "id") -> DataFrame:
    """One row for each symbol and exchange with the latest row of each named timeframe as a struct, null if none."""
    value = F.struct(*columns)
    picks = [F.max_by(F.when(F.col("timeframe") == tf, value), F.when(F.col("timeframe") == tf, F.col(order))).alias(name) for name, tf in labels.items()]
    return rows.groupBy("symbol", "exchange").agg(*picks)


def as_of(left: DataFrame, right: DataFrame, keys: list[str], time: str, columns: list[str]) -> DataFrame:
    """left with the columns of the latest right row at or before its time, null if none; one shuffle, no range join."""
    # right rows of equal time come first, so that a left row of the same time sees them
    side = left.select(*keys, F.col(time).alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_l"), F.lit(None).cast(right.select(F.struct(*columns)).schema[0].dataType).alias("_r"))
    other = right.select(*keys, F.col(time).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias("_l"), F.struct(*columns).alias("_r"))
    w = W.partitionBy(*keys).orderBy("_t", "_side").rowsBetween(W.unboundedPreceding, 0)
    both = side.unionByName(other).withColumn("_seen", F.last("_r", ignorenulls=True).over(w))
    return both.where("_side = 1").select("_l.*", *[F.col(f"_seen.{c}").alias(c) for c in columns])


def nearest(left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str, value: str) -> DataFrame:
    """left with the value of the right row nearest to its position (numbers); of two equally near the earlier one.

    Of right rows at one position the smallest value counts. Both frames run from an end of the series, so a row costs
    the same wherever it stands.
    """
    kind = right.schema[value].dataType
    r = F.struct(F.col(right_at).cast("long").alias("at"), F.col(value).alias("v"))
    none = F.lit(None).cast(right.select(r.alias("r")).schema["r"].dataType)
    a = left.select(*keys, F.col(left_at).cast("long").alias("_t"), F.struct(*left.columns).alias("_l"), none.alias("_r"), F.lit(1).alias("_side"))
    b = right.select(*keys, F.col(right_at).cast("long").alias("_t"), F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias("_l"), r.alias("_r"), F.lit(0).alias("_side"))
    # right rows of equal position come first both ways, the smallest value last of them
    back, on = (W.partitionBy(*keys).orderBy(t, "_side", F.desc("_r.v")).rowsBetween(W.unboundedPreceding, 0) for t in ("_t", F.desc("_t")))
    seen = F.last("_r", ignorenulls=True)
    both = a.unionByName(b).withColumns({"_b": seen.over(back), "_f": seen.over(on)})
    earlier = F.col("_f").isNull() | (F.col("_t") - F.col("_b.at") <= F.col("_f.at") - F.col("_t"))
    picked = F.when(F.col("_b").isNotNull() & earlier, F.col("_b.v")).otherwise(F.col("_f.v")).cast(kind)
    return both.where("_l is not null").select("_l.*", picked.alias(value))


ACCEPT = ("strong_accept", "weak_accept", "second_push")
REJECT = ("strong_reject", "weak_reject")
DEFAULTS = {"gate_consistency": 7, "gate_conflicts": 0, "cooldown_active": False, "prefer_close_over_open": True, "position": "flat"}


def context(rows: DataFrame) -> DataFrame:
    """Decision inputs from rows(symbol, exchange, higher, trade, entry, behavior, strength).

    higher, trade and entry are structs of score, stage, dominance, efficiency and sustainability; a missing one counts
    as score 0, failed. behavior and strength are the entry timeframe's zone signal, null without one.
    """
    b = F.col("behavior")

    def direction(x: str):
        return S.score_direction(F.coalesce(F.col(f"{x}.score"), F.lit(0.0)))

    accept = F.coalesce(b.isin(*ACCEPT), F.lit(False))
    return rows.select(
        "symbol",
        "exchange",
        direction("higher").alias("higher_direction"),
        direction("trade").alias("trade_direction"),
        direction("entry").alias("entry_direction"),
        F.coalesce(b.isin(*REJECT), F.lit(False)).alias("has_keyzone_conflict"),
        accept.alias("is_accept_state"),
        b.alias("keyzone_behavior"),
        F.coalesce("strength", F.lit(0.0)).alias("keyzone_strength"),
        accept.alias("second_push_ready"),
        F.coalesce(b == "breakout_failure", F.lit(False)).alias("breakout_failure"),
        *[F.lit(v).alias(k) for k, v in DEFAULTS.items()],
        F.coalesce("entry.stage", F.lit("failed")).alias("sd_stage"),
        *[F.coalesce(f"entry.{x}", F.lit(0.0)).alias(f"sd_{x}") for x in ("score", "dominance", "efficiency", "sustainability")],
    )


def decide(rows: DataFrame) -> DataFrame:
    """rows with action and reason, by the first of an ordered chain of rules that holds."""
    c = F.col
    behavior, position, score = F.coalesce(c("keyzone_behavior"), F.lit("none")), c("position"), c("sd_score")
    higher = c("higher_direction")
    aligned = (higher == c("trade_direction")) & (c("trade_direction") == c("entry_direction")) & (higher != 0)
    base = F.when(c("sd_stage") == "stable", 0.35).when(c("sd_stage") == "weakening", 0.45).when(c("sd_stage") == "critical", 0.55).otherwise(1.0)
    shifts = {"strong_accept": -0.10, "weak_accept": -0.05, "second_push": -0.08, "weak_reject": 0.08, "strong_reject": 0.12, "breakout_failure": 0.15}
    shift = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in shifts.items() for x in kv]), behavior), F.lit(0.0))
    least = S.clamp(base + shift, 0.2, 0.8)
    quality = S.clamp(0.4 * c("sd_dominance") + 0.35 * c("sd_efficiency") + 0.25 * c("sd_sustainability"), -1, 1)
    fit = aligned & (quality >= -0.1) & c("is_accept_state")
    bull, bear = fit & (higher == 1) & (score >= least), fit & (higher == -1) & (score <= -least)
    risky = (c("gate_consistency") <= 4) | (c("gate_conflicts") >= 3) | ((c("keyzone_strength") > 0.7) & behavior.isin("strong_reject", "breakout_failure"))
    passed = (c("gate_consistency") >= 7) & ~risky
    failure = c("breakout_failure") | (behavior == "breakout_failure")
    close_first = c("prefer_close_over_open")
    # actions and reasons are fixed values
    rules = [
        (c("cooldown_active"), "wait", "cooldown active"),
        (failure & (position == "long"), "sell", "breakout failure: close long first"),
        (failure & (position == "short"), "cover", "breakout failure: close short first"),
        (failure, "wait", "breakout failure: no open position"),
        (c("has_keyzone_conflict"), "wait", "keyzone conflict"),
        (c("sd_stage") == "failed", "wait", "sd not reliable"),
        (close_first & (position == "long") & (~bull | (score < 0) | ~c("is_accept_state")), "sell", "close-long priority on signal degradation"),
        (close_first & (position == "short") & (~bear | (score > 0) | ~c("is_accept_state")), "cover", "close-short priority on signal degradation"),
        (~aligned, "wait", "multi timeframe conflict"),
        (~passed, "wait", "execution gate not passed"),
        (~c("second_push_ready"), "wait", "waiting second push confirmation"),
        (bull & (position == "flat"), "buy", "bullish dominance confirmed"),
        (bear & (position == "flat"), "short", "bearish dominance confirmed"),
        (bull & (position == "short"), "cover", "bullish reversal: close short"),
        (bear & (position == "long"), "sell", "bearish reversal: close long"),
    ]
    told = F.when(rules[0][0], F.struct(F.lit(rules[0][1]).alias("action"), F.lit(rules[0][2]).alias("reason")))
    for on, action, reason in rules[1:]:
        told = told.when(on, F.struct(F.lit(action).alias("action"), F.lit(reason).alias("reason")))
    told = told.otherwise(F.struct(F.lit("wait").alias("action"), F.lit("edge too weak").alias("reason")))
    return rows.withColumn("_told", told).select(*rows.columns, "_told.action", "_told.reason")
