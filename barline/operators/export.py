"""Structures as candles, markers and segments for charts, and audits of structures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barline.functions import scalars as S
from barline.operators import structure

KEYS = structure.KEYS


def cbar_axis(bars: DataFrame, merged: DataFrame) -> DataFrame:
    """Merged bars as candles on an axis of their own, a minute apart after the last bar; they open at the middle before."""
    end = bars.groupBy(*KEYS).agg(F.max(F.unix_timestamp("datetime")).alias("last"))
    w = W.partitionBy(*KEYS).orderBy("id")
    middle = (F.col("high_price") + F.col("low_price")) / 2
    rows = merged.withColumn("close", middle).withColumn("open", F.coalesce(F.lag("close").over(w), F.col("close")))
    return rows.join(end, KEYS).select(*KEYS, F.col("id").cast("string").alias("id"), (F.col("last") + 60 * F.col("id")).alias("time"), "open", F.col("high_price").alias("high"), F.col("low_price").alias("low"), "close")


def cbar_candles(bars: DataFrame, merged: DataFrame) -> DataFrame:
    """A candle for each bar with the range of its merged bar."""
    rows = structure.cbar_of_each_bar(bars, merged)
    middle = (F.col("cbar_high") + F.col("cbar_low")) / 2
    return rows.select(*KEYS, "sbar_id", F.unix_timestamp("datetime").alias("time"), middle.alias("open"), F.col("cbar_high").alias("high"), F.col("cbar_low").alias("low"), middle.alias("close"))


def segments(swing_rows: DataFrame, merged: DataFrame, bars: DataFrame) -> DataFrame:
    """Swings as lines between the anchor prices and times of their merged bars; swings without them are left out."""
    labelled = structure.label_fractals(merged)
    times = bars.select(*KEYS, F.col("id").alias("bar"), F.unix_timestamp("datetime").alias("t"))

    def end(name: str, bar: str):
        rows = labelled.join(times, (F.col(bar) == F.col("bar")) & (labelled["symbol"] == times["symbol"]) & (labelled["exchange"] == times["exchange"]) & (labelled["timeframe"] == times["timeframe"]))
        return rows.select(*[labelled[k] for k in KEYS], labelled["id"].alias(f"cbar_{name}_id"), F.struct("t", "fractal_type", labelled["high_price"], labelled["low_price"]).alias(name))

    rows = swing_rows.select(*KEYS, "id", "direction", "state", "cbar_start_id", "cbar_end_id")
    rows = rows.join(end("start", "sbar_start_id"), [*KEYS, "cbar_start_id"]).join(end("end", "sbar_end_id"), [*KEYS, "cbar_end_id"])

    out = rows
    for name, first in (("start", True), ("end", False)):
        out = out.withColumns({"high_price": F.col(f"{name}.high_price"), "low_price": F.col(f"{name}.low_price")})
        out = out.withColumns({f"{name}_price": S.anchor_price(F.col(f"{name}.fractal_type"), "direction", F.lit(first)), f"{name}_time": F.col(f"{name}.t")})
    return out.select(*KEYS, "id", "direction", F.array(F.lit("forming"), F.lit("pending"), F.lit("completed"))[F.col("state")].alias("state"), "start_time", "start_price", "end_time", "end_price")


def payload(parts: dict[str, DataFrame]) -> DataFrame:
    """One JSON text for each series from named parts, each a sorted list of its rows; for exports of single series."""
    out = None
    for name, rows in parts.items():
        rest = [c for c in rows.columns if c not in KEYS]
        own = rows.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct(*rest))).alias(name))
        out = own if out is None else out.join(own, KEYS, "full")
    return out.select(*KEYS, F.to_json(F.struct(*parts)).alias("payload"))


def audit(bars: DataFrame, merged: DataFrame, swing_rows: DataFrame, trend_rows: DataFrame) -> DataFrame:
    """Counts of each series' structures and of what breaks their rules."""

    def counts(rows: DataFrame, **named):
        return rows.groupBy(*KEYS).agg(*[e.alias(k) for k, e in named.items()])

    n = F.count("*")
    labelled = structure.label_fractals(merged)
    w = W.partitionBy(*KEYS).orderBy("id")
    kinds = labelled.select(*KEYS, F.col("id").alias("cbar"), F.col("fractal_type").alias("kind"))
    done = swing_rows.where(F.col("state") == 2)
    ends = done.join(kinds.withColumnRenamed("cbar", "cbar_start_id").withColumnRenamed("kind", "from"), [*KEYS, "cbar_start_id"], "left")
    ends = ends.join(kinds.withColumnRenamed("cbar", "cbar_end_id").withColumnRenamed("kind", "to"), [*KEYS, "cbar_end_id"], "left")
    wrong = (F.coalesce("from", F.lit(0)) != -F.col("direction")) | (F.coalesce("to", F.lit(0)) != F.col("direction"))
    gaps = done.withColumn("before", F.lag("cbar_end_id").over(w)).where("before <> cbar_start_id")
    same = structure.trend_stats(trend_rows, swing_rows).join(trend_rows.where("is_completed").select(*KEYS, F.col("id").alias("trend_id")), [*KEYS, "trend_id"])
    parts = [
        counts(bars, bars=n),
        counts(merged, cbars=n),
        counts(swing_rows, swings=n, completed_swings=F.count_if(F.col("state") == 2)),
        counts(trend_rows, trends=n, completed_trends=F.count_if("is_completed")),
        counts(structure.inclusive_pairs(merged), inclusive_violations=n),
        counts(ends.where(wrong), swing_violations=n),
        counts(gaps, gap_violations=n),
        counts(same.where("same_direction = 0"), trend_violations=n),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, KEYS, "left")
    return out.na.fill(0)


def first_violations(rows: DataFrame, limit: int = 30) -> DataFrame:
    """The first rows of a report, with how many there are in all."""
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(*KEYS, "id").limit(limit).join(F.broadcast(total))


def time_axis(rows: DataFrame, time: str = "datetime") -> DataFrame:
    """rows with the rank of their time among all times of their series."""
    return rows.withColumn("axis", F.dense_rank().over(W.partitionBy(*KEYS).orderBy(time)) - 1)


def segment_at(points: DataFrame, lines: DataFrame, at: str, start: str, end: str) -> DataFrame:
    """Each point with the last segment (by id) that spans it; whole-number positions, so the join is an equi join."""
    spans = lines.select(*KEYS, F.col("id").alias("segment_id"), F.explode(F.sequence(start, end)).alias(at))
    last = spans.groupBy(*KEYS, at).agg(F.max("segment_id").alias("segment_id"))
    return points.join(last, [*KEYS, at], "left")
