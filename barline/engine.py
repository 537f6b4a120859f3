"""All structures of a set of bars under one roof; everything is lazy until a result is asked for."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.operators import bars as B
from barline.operators import decision, export, routing, structure, supply, zones
from barline.sources import writers


class Engine:
    """Bars of registered timeframes, from fine to coarse: entry, trade and higher. Bars of others are ignored."""

    def __init__(self, bars: DataFrame, timeframes: tuple[str, ...] = ("m5", "m15", "h1"), semantics: str = "spec", config: supply.SupplyConfig | None = None, patches: DataFrame | None = None):
        self.timeframes, self.semantics = tuple(timeframes), semantics
        self.config, self.patches = config or supply.SupplyConfig(), patches
        self.bars = B.keep_registered(bars, list(timeframes))

    @classmethod
    def from_ticks(cls, ticks: DataFrame, timeframes: tuple[str, ...] = ("m5", "m15", "h1"), **options) -> Engine:
        return cls(B.fan_out(B.tick_to_m1(ticks, flush=False), list(timeframes)), timeframes, **options)

    @cached_property
    def cbars(self) -> DataFrame:
        return structure.label_fractals(structure.cbars(self.bars))

    @cached_property
    def swings(self) -> DataFrame:
        return structure.swings(self.bars, self.semantics)

    @cached_property
    def trends(self) -> DataFrame:
        return structure.trends(self.bars, self.semantics)

    @cached_property
    def zones(self) -> DataFrame:
        return zones.zones(self.swings, self.trends, self.bars)

    @cached_property
    def signals(self) -> DataFrame:
        """The strongest reaction of each series' last bar to its zones."""
        return zones.best(zones.reactions(self.zones, zones.latest_bars(self.bars)))

    @cached_property
    def scores(self) -> DataFrame:
        """The score of each bar's window; the last bar's has the bias of the zone signal."""
        bias = self.signals.select(*structure.KEYS, F.col("sbar_id").alias("id"), F.col("signed_strength").alias("bias"))
        rows = self.bars.join(bias, [*structure.KEYS, "id"], "left")
        if self.patches is not None:
            return supply.score(supply.overlay(rows, self.patches), bias="bias", config=None)
        return supply.score(rows, bias="bias", config=self.config)

    def count(self, timeframe: str) -> int:
        return self.bars.where(F.col("timeframe") == timeframe).count()

    def snapshot(self) -> DataFrame:
        """The latest score of each of the three timeframes and the entry timeframe's zone signal."""
        entry, trade, higher = self.timeframes
        columns = ["id", "score", "stage", "dominance", "efficiency", "sustainability"]
        latest = decision.snapshot(self.scores, {"higher": higher, "trade": trade, "entry": entry}, columns)
        signal = self.signals.where(F.col("timeframe") == entry).select("symbol", "exchange", "behavior", "strength", "zone_id")
        return latest.join(signal, ["symbol", "exchange"], "left")

    def decisions(self) -> DataFrame:
        return decision.decide(decision.context(self.snapshot()))

    def events(self) -> DataFrame:
        return routing.change_events(self.bars)

    def audit(self) -> DataFrame:
        return export.audit(self.bars, self.cbars, self.swings, self.trends)

    def write_snapshot(self, path: str) -> None:
        writers.parquet_snapshot({"sbar": self.bars, "cbar": self.cbars, "swing": self.swings, "trend": self.trends}, path)
