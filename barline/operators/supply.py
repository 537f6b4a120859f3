"""The supply/demand score of a rolling window of bars: nine factors in three layers, nine atoms and a stage.

All window aggregates share one frame, so a series is shuffled and sorted once.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields, replace

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barline.functions import scalars as S

KEYS = ["symbol", "exchange", "timeframe"]


@dataclass(frozen=True)
class SupplyConfig:
    """Weights and thresholds; fixed default values."""

    layer1_weight: float = 0.45
    layer2_weight: float = 0.30
    layer3_weight: float = 0.25
    f1_weight: float = 0.4
    f2_weight: float = 0.4
    f3_weight: float = 0.2
    f4_weight: float = 0.4
    f5_weight: float = 0.2
    f6_weight: float = 0.4
    f7_weight: float = 0.5
    f8_weight: float = 0.25
    f9_weight: float = 0.25
    stable_threshold: float = 0.70
    weakening_threshold: float = 0.45
    critical_threshold: float = 0.25
    keyzone_bias_scale: float = 0.35

    def patched(self, patch: dict | None) -> SupplyConfig:
        """With the known, non-null values of a patch."""
        names = {f.name for f in fields(self)}
        return replace(self, **{k: float(v) for k, v in (patch or {}).items() if k in names and v is not None})


@dataclass
class SupplyProfile:
    """Patches by level, from general to special."""

    default: dict | None = None
    timeframes: dict | None = None
    symbols: dict | None = None
    symbol_timeframes: dict | None = None

    def resolve(self, symbol: str, timeframe: str) -> SupplyConfig:
        """The configuration of a symbol and timeframe; keys don't depend on case or outer white space."""
        s, t = symbol.strip().lower(), timeframe.strip().lower()
        out = SupplyConfig().patched(self.default)
        for level, keys in ((self.timeframes, [t]), (self.symbols, [s]), (self.symbol_timeframes, [f"*.{t}", f"{s}.*", f"{s}.{t}"])):
            known = {k.strip().lower(): v for k, v in (level or {}).items()}
            for key in keys:
                out = out.patched(known.get(key))
        return out


FACTORS = ["f1", "f2", "f3", "f4", "f5", "f6", "f7", "f8", "f9"]
ATOMS = ["a", "b", "c", "d", "e", "f", "g", "h", "i"]
SUMMARY = ["dominance", "efficiency", "sustainability", "volatility_adjustment"]


def _param(config: SupplyConfig | None, name: str):
    return F.lit(getattr(config, name)) if config is not None else F.col(f"cfg.{name}")


def score(bars: DataFrame, length: int = 50, bias: str | None = None, config: SupplyConfig | None = SupplyConfig(), tanh=F.tanh) -> DataFrame:
    """Keys and id of each bar with the score, stage, factors and atoms of the window of `length` bars that it ends.

    bias: a column of zone reaction between -1 and 1. config=None takes the parameters of each row from its column
    cfg, a struct, as overlay() makes it. tanh: the function of a column that the volatility adjustment takes.
    """
    order = W.partitionBy(*KEYS).orderBy("id")
    w = order.rowsBetween(-(length - 1), 0)
    body, rng = S.body(), S.total_range()
    way = S.rsign(F.col("close_price") - F.col("open_price"))
    rows = bars.withColumns(
        {
            "_range": rng,
            "_wick": F.greatest(S.upper_shadow(), F.lit(0.0)) + F.greatest(S.lower_shadow(), F.lit(0.0)),
            "_ratio": F.when(F.abs(rng) >= S.EPSILON, S.clamp(body / F.nullif(rng, F.lit(0.0)), 0, 1)).otherwise(0.0),
            "_up": (F.col("close_price") > F.col("open_price")).cast("int"),
            "_down": (F.col("close_price") < F.col("open_price")).cast("int"),
            "_way": way,
            "_bias": F.coalesce(F.col(bias), F.lit(0.0)) if bias else F.lit(0.0),
        }
    ).withColumn("_flip", (F.col("_way") != F.lag("_way").over(order)).cast("int"))
    flips = F.coalesce(F.sum("_flip").over(order.rowsBetween(-(length - 2), 0)), F.lit(0)) if length > 1 else F.lit(0)
    rows = rows.withColumns(
        {
            "_n": F.count("*").over(w),
            "_open": F.first("open_price").over(w),
            "_first_oi": F.first("open_interest").over(w),
            "_total": F.sum("_range").over(w),
            "_wicks": F.sum("_wick").over(w),
            "_body": F.avg("_ratio").over(w),
            "_ups": F.sum("_up").over(w),
            "_downs": F.sum("_down").over(w),
            "_mean": F.avg("volume").over(w),
            "_flips": flips,
        }
    )
    c = F.col
    move, oi = c("close_price") - c("_open"), c("open_interest") - c("_first_oi")
    count = c("_ups") + c("_downs")
    rows = rows.withColumns(
        {
            "_pd": S.rsign(move),
            "f2": F.when(F.abs("_total") < S.EPSILON, 0.0).otherwise(S.clamp(move / F.nullif("_total", F.lit(0.0)), -1, 1)),
            "_signed": F.when(count == 0, 0.0).otherwise((c("_ups") - c("_downs")) / F.nullif(count, F.lit(0))),
            "f4": F.when(F.abs("_mean") < S.EPSILON, 0.0).otherwise(S.clamp(c("volume") / F.nullif("_mean", F.lit(0.0)) - 1, -1, 1)),
        }
    )
    rows = rows.withColumns(
        {
            "f1": S.clamp(c("_body") - c("_wicks") / (c("_total") + 1e-9), -1, 1),
            "f3": S.clamp(1 - c("_flips") / c("_n"), 0, 1) * c("_pd"),
            "f5": F.when(F.abs(oi) < S.EPSILON, 0.0).otherwise(S.rsign(oi) * c("_pd")),
            "f7": c("f2"),
            "f8": S.clamp(S.clamp(c("_body") - 0.5, -1, 1) * c("_pd") + S.clamp(c("_bias"), -1, 1) * _param(config, "keyzone_bias_scale"), -1, 1),
            "f9": S.rsign(c("_signed")) * c("_pd"),
        }
    ).withColumn("f6", S.clamp(c("f4") * c("f5"), -1, 1))
    rows = rows.withColumns(
        {
            "a": S.clamp(F.abs("f2") * F.abs("f4"), 0, 1) * c("_pd"),
            "b": c("f3"),
            "c": S.clamp(c("_body") - 0.4, -1, 1) * c("_pd"),
            "d": c("f2"),
            "e": c("f1"),
            "f": c("f6"),
            "g": S.clamp(0.5 - F.abs("f2"), -1, 1),
            "h": F.when(c("f8") * c("_pd") < 0, 1.0).otherwise(-1.0),
            "i": S.clamp(-c("f3"), -1, 1),
        }
    )

    def layer(*names: str):
        return sum((_param(config, f"{x}_weight") * c(x) for x in names[1:]), _param(config, f"{names[0]}_weight") * c(names[0]))

    total = _param(config, "layer1_weight") * layer("f1", "f2", "f3") + _param(config, "layer2_weight") * layer("f4", "f5", "f6") + _param(config, "layer3_weight") * layer("f7", "f8", "f9")
    rows = rows.withColumns(
        {
            "score": S.clamp(total, -1, 1),
            "dominance": S.clamp((c("a") + c("b") + c("c")) / 3, -1, 1),
            "efficiency": S.clamp((c("d") + c("e") + c("f")) / 3, -1, 1),
            "sustainability": S.clamp(1 - (F.greatest("g", F.lit(0.0)) + F.greatest("h", F.lit(0.0)) + F.greatest("i", F.lit(0.0))) / 3, 0, 1),
            "volatility_adjustment": S.clamp(1 - tanh(c("_total") / (c("_n") + 1)), 0, 1),
        }
    )
    size = F.abs("score")
    stage = F.when(size >= _param(config, "stable_threshold"), "stable").when(size >= _param(config, "weakening_threshold"), "weakening").when(size >= _param(config, "critical_threshold"), "critical").otherwise("failed")
    return rows.select(*KEYS, "id", "datetime", "score", stage.alias("stage"), *FACTORS, *ATOMS, *SUMMARY)


def latest(scores: DataFrame) -> DataFrame:
    """The last row of each series."""
    rest = [x for x in scores.columns if x not in KEYS]
    return scores.groupBy(*KEYS).agg(F.max_by(F.struct(*rest), "id").alias("x")).select(*KEYS, "x.*")


def overlay(rows: DataFrame, patches: DataFrame) -> DataFrame:
    """rows with cfg, the parameters of their symbol and timeframe.

    patches(level, key, one column for each parameter, null where it isn't set) has the levels "default" (key ""),
    "timeframe", "symbol" and "symbol_timeframe" (keys "*.tf", "symbol.*", "symbol.tf"). It is a configuration table and
    joined by level; the special level wins.
    """
    names = list(asdict(SupplyConfig()))
    known = [x for x in names if x in patches.columns]
    table = patches.select("level", S.normalize_key("key").alias("key"), *known)
    symbol, tf = S.normalize_key("symbol"), S.normalize_key("timeframe")
    levels = [("default", F.lit("")), ("timeframe", tf), ("symbol", symbol), ("symbol_timeframe", F.concat(F.lit("*."), tf)), ("symbol_timeframe", F.concat(symbol, F.lit(".*"))), ("symbol_timeframe", F.concat(symbol, F.lit("."), tf))]
    out = rows
    for i, (level, key) in enumerate(levels):
        own = table.where(F.col("level") == level).select(F.col("key").alias(f"_k{i}"), F.struct(*known).alias(f"_p{i}"))
        out = out.join(own, key == F.col(f"_k{i}"), "left")
    defaults = SupplyConfig()
    values = [F.coalesce(*[F.col(f"_p{i}.{x}") for i in reversed(range(len(levels))) if x in known], F.lit(getattr(defaults, x))).cast("double").alias(x) for x in names]
    return out.select(*rows.columns, F.struct(*values).alias("cfg"))
