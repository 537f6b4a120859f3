"""Merged bars, fractals, swings and trends of each series.

The folds are order-dependent: one task takes a series, in the order of its ids, and makes one pass. Everything
that isn't a fold (labels, neighbours, ranges, audits) is DataFrame expressions.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barline.functions import scalars as S
from barline.operators import cores

KEYS = ["symbol", "exchange", "timeframe"]
_KEYS = "symbol string, exchange string, timeframe string"
CBAR = f"{_KEYS}, id long, sbar_start_id long, sbar_end_id long, high_price double, low_price double"
SWING = f"{_KEYS}, id long, direction int, cbar_start_id long, cbar_end_id long, sbar_start_id long, sbar_end_id long, high_price double, low_price double, span int, volume double, start_oi double, end_oi double, state int"
TREND = f"{_KEYS}, id long, direction int, swing_start_id long, swing_end_id long, sbar_start_id long, sbar_end_id long, high_price double, low_price double, span int, volume double, start_oi double, end_oi double, is_completed boolean"


def _frame(keys: tuple, rows: list[tuple], schema: str) -> pd.DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]
    return pd.DataFrame([(*keys, *r) for r in rows], columns=names)


def _fold(bars: DataFrame, columns: list[str], schema: str, make) -> DataFrame:
    """make(frame in order) -> rows, for each series. Ids of bars are their numbers in the series."""

    def run(keys: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        return _frame(keys, make(frame.sort_values("id", kind="stable")), schema)

    return bars.select(*KEYS, "id", *columns).groupBy(*KEYS).applyInPandas(run, schema)


def cbars(bars: DataFrame) -> DataFrame:
    """Merged bars: neighbours never contain each other; each spans bars sbar_start_id to sbar_end_id."""

    def make(f: pd.DataFrame) -> list[tuple]:
        return [(i, *r) for i, r in enumerate(cores.cbars(f["high_price"].tolist(), f["low_price"].tolist()), 1)]

    return _fold(bars, ["high_price", "low_price"], CBAR, make)


def _swing_rows(f: pd.DataFrame, semantics: str) -> list[cores.Swing]:
    return cores.swings(cores.cbars(f["high_price"].tolist(), f["low_price"].tolist()), semantics)


def swings(bars: DataFrame, semantics: str = "spec") -> DataFrame:
    """Swings of bars (see cores.swings for the semantics), folded from the bars in one pass."""

    def make(f: pd.DataFrame) -> list[tuple]:
        return [(s.number, s.direction, s.start, s.end, s.sbar_start, s.sbar_end, s.high, s.low, s.span, s.volume, s.start_oi, s.end_oi, s.state) for s in _swing_rows(f, semantics)]

    return _fold(bars, ["high_price", "low_price"], SWING, make)


def _trend_rows(rows: list[cores.Swing]) -> list[tuple]:
    return [(t.number, t.direction, t.start, t.end, t.sbar_start, t.sbar_end, t.high, t.low, t.span, t.volume, t.start_oi, t.end_oi, t.completed) for t in cores.trends(rows)]


def trends(bars: DataFrame, semantics: str = "spec") -> DataFrame:
    """Trends of the confirmed swings of bars; both folds run in one pass. A row that a pullback overwrote has id 0."""
    return _fold(bars, ["high_price", "low_price"], TREND, lambda f: _trend_rows(_swing_rows(f, semantics)))


def trends_of_swings(rows: DataFrame) -> DataFrame:
    """Trends of given swings, in the columns of swings()."""

    def run(keys: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        f = frame.sort_values("id", kind="stable")
        cols = ["direction", "cbar_start_id", "cbar_end_id", "sbar_start_id", "sbar_end_id", "high_price", "low_price", "state", "id", "span", "volume", "start_oi", "end_oi"]
        return _frame(keys, _trend_rows([cores.Swing(*r) for r in f[cols].itertuples(index=False, name=None)]), TREND)

    return rows.groupBy(*KEYS).applyInPandas(run, TREND)


def _near(order: str = "id"):
    w = W.partitionBy(*KEYS).orderBy(order)
    return w, [(F.lag(h).over(w), F.lag(l).over(w)) for h, l in [("high_price", "low_price")]][0], [(F.lead(h).over(w), F.lead(l).over(w)) for h, l in [("high_price", "low_price")]][0]


def label_fractals(rows: DataFrame) -> DataFrame:
    """rows with fractal_type by the three-row rule; the first and last of a series have 0."""
    _, left, right = _near()
    return rows.withColumn("fractal_type", S.fractal_code(left, ("high_price", "low_price"), right))


def envelopes(rows: DataFrame) -> DataFrame:
    """The fractals among rows with the highest and lowest price of their three rows."""
    _, (lh, ll), (rh, rl) = _near()
    out = label_fractals(rows).withColumn("envelope_high", F.greatest(lh, "high_price", rh)).withColumn("envelope_low", F.least(ll, "low_price", rl))
    return out.where("fractal_type <> 0")


def fractal_neighbours(rows: DataFrame) -> DataFrame:
    """rows with the ids of the nearest fractals before and after each."""
    w = W.partitionBy(*KEYS).orderBy("id")
    at = F.when(F.col("fractal_type") != 0, F.col("id"))
    out = label_fractals(rows)
    before = F.last(at, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    # from the other end, as a frame that reaches to the end would be read anew for each row
    after = F.last(at, ignorenulls=True).over(W.partitionBy(*KEYS).orderBy(F.desc("id")).rowsBetween(W.unboundedPreceding, -1))
    return out.withColumn("prev_fractal_id", before).withColumn("next_fractal_id", after)


def last_fractal(rows: DataFrame) -> DataFrame:
    """The last fractal of each series."""
    found = label_fractals(rows).where("fractal_type <> 0")
    return found.groupBy(*KEYS).agg(F.max("id").alias("id"), F.max_by("fractal_type", "id").alias("fractal_type"))


def inclusive_pairs(rows: DataFrame) -> DataFrame:
    """Neighbours of which one contains the other; merged bars have none."""
    _, (lh, ll), _ = _near()
    inclusive = S.is_inclusive(lh, ll, "high_price", "low_price")
    return rows.withColumn("inclusive", F.coalesce(inclusive, F.lit(False))).where("inclusive").drop("inclusive")


def cbar_of_each_bar(bars: DataFrame, merged: DataFrame) -> DataFrame:
    """Each bar with the merged bar that spans it: ids are dense, so the range join is an equi join."""
    number = F.explode(F.sequence("sbar_start_id", "sbar_end_id")).alias("sbar_id")
    spans = merged.select(*KEYS, F.col("id").alias("cbar_id"), F.col("high_price").alias("cbar_high"), F.col("low_price").alias("cbar_low"), number)
    return bars.withColumnRenamed("id", "sbar_id").join(spans, [*KEYS, "sbar_id"])


def range_verify(bars: DataFrame, merged: DataFrame) -> DataFrame:
    """For each merged bar whether its range is that of its bars and of a single one of them."""
    rows = cbar_of_each_bar(bars, merged).groupBy(*KEYS, "cbar_id")
    whole = (F.col("high_price") == F.col("cbar_high")) & (F.col("low_price") == F.col("cbar_low"))
    out = rows.agg(F.max("high_price").alias("h"), F.min("low_price").alias("l"), F.max("cbar_high").alias("ch"), F.min("cbar_low").alias("cl"), F.max(whole.cast("int")).alias("single"), F.count("*").alias("n_bars"))
    return out.select(*KEYS, F.col("cbar_id").alias("id"), ((F.col("h") == F.col("ch")) & (F.col("l") == F.col("cl"))).alias("range_ok"), (F.col("single") == 1).alias("single_ok"), "n_bars")


def range_stats(segments: DataFrame, merged: DataFrame) -> DataFrame:
    """For each segment (cbar_start_id to cbar_end_id) the prices and bars of the merged bars it spans."""
    number = F.explode(F.sequence(F.least("cbar_start_id", "cbar_end_id"), F.greatest("cbar_start_id", "cbar_end_id"))).alias("cbar_id")
    spans = segments.select(*KEYS, F.col("id").alias("segment_id"), number)
    rows = spans.join(merged.withColumnRenamed("id", "cbar_id"), [*KEYS, "cbar_id"])
    return rows.groupBy(*KEYS, "segment_id").agg(F.max("high_price").alias("high_price"), F.min("low_price").alias("low_price"), F.min("sbar_start_id").alias("sbar_start_id"), F.max("sbar_end_id").alias("sbar_end_id"))


def trend_stats(segments: DataFrame, rows: DataFrame) -> DataFrame:
    """For each trend (swing_start_id to swing_end_id) the sums and ends of the swings it spans."""
    number = F.explode(F.sequence("swing_start_id", "swing_end_id")).alias("swing_id")
    spans = segments.select(*KEYS, F.col("id").alias("trend_id"), F.col("direction").alias("trend_direction"), number)
    joined = spans.join(rows.withColumnRenamed("id", "swing_id"), [*KEYS, "swing_id"])
    return joined.groupBy(*KEYS, "trend_id").agg(
        F.sum("span").cast("long").alias("span"),
        F.sum("volume").alias("volume"),
        F.min_by("start_oi", "swing_id").alias("start_oi"),
        F.max_by("end_oi", "swing_id").alias("end_oi"),
        F.count_if(F.col("direction") == F.col("trend_direction")).alias("same_direction"),
    )


def neighbours(rows: DataFrame) -> DataFrame:
    """rows with the ids before and after them in their series."""
    w = W.partitionBy(*KEYS).orderBy("id")
    return rows.select(*KEYS, "id", F.lag("id").over(w).alias("prev_id"), F.lead("id").over(w).alias("next_id"))


def first_changed(before: DataFrame, now: DataFrame, columns: list[str], growth_counts: bool = True) -> DataFrame:
    """For each series the id of the first row that differs between two states; null if none does."""
    old = before.select(*KEYS, "id", F.struct(*columns).alias("old"))
    new = now.select(*KEYS, "id", F.struct(*columns).alias("new"))
    both = old.join(new, [*KEYS, "id"], "full")
    differs = F.when(F.col("old").isNull(), F.lit(growth_counts)).when(F.col("new").isNull(), True).otherwise(F.col("old") != F.col("new"))
    return both.groupBy(*KEYS).agg(F.min(F.when(differs, F.col("id"))).alias("backtrack_id"))


def _running(bars: DataFrame, columns: list[str], name: str, make) -> DataFrame:
    """A value for each bar from a state that make() starts for each series and that takes the bars in order.

    Rows stream through the task in order of series and id, so memory doesn't grow with a series.
    """

    def run(frames):
        key, step = None, None
        for f in frames:
            out = []
            for row in f.itertuples(index=False, name=None):
                if row[:3] != key:
                    key, step = row[:3], make()
                out.append(step(*row[4:]))
            yield f[[*KEYS, "id"]].assign(**{name: out})

    rows = bars.select(*KEYS, "id", *columns).repartition(*KEYS).sortWithinPartitions(*KEYS, "id")
    return rows.mapInPandas(run, f"{_KEYS}, id long, {name} double")


def ema(bars: DataFrame, n: int) -> DataFrame:
    """Exponential average of closes."""
    return _running(bars, ["close_price"], "ema", lambda: cores.Ema(n))


def atr(bars: DataFrame, n: int) -> DataFrame:
    """Wilder's average true range."""
    return _running(bars, ["high_price", "low_price", "close_price"], "atr", lambda: cores.Atr(n))


class Indicators:
    """A registry of indicators: name -> bars to (keys, id, value); a name registers once."""

    def __init__(self):
        self.made = {}

    def register(self, name: str, make) -> bool:
        return self.made.setdefault(name, make) is make

    def apply(self, bars: DataFrame) -> DataFrame:
        """The keys and ids of bars with a column for each indicator."""
        out = bars.select(*KEYS, "id")
        for name, make in self.made.items():
            rows = make(bars)
            value = next(c for c in rows.columns if c not in (*KEYS, "id"))
            out = out.join(rows.select(*KEYS, "id", F.col(value).alias(name)), [*KEYS, "id"], "left")
        return out
