"""Sources. All are lazy scans but for small configuration files."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barline.functions import scalars as S
from barline.operators.bars import BAR

#: Columns of bar files with their other names; fixed values.
ALIASES = {"open_price": ["open"], "high_price": ["high"], "low_price": ["low"], "close_price": ["close"], "turnover": ["money"], "datetime": ["time"], "volume": [], "open_interest": []}
REQUIRED = ["datetime", "open_price", "high_price", "low_price", "close_price"]
POSITIONS = ["datetime", "open_price", "close_price", "high_price", "low_price", "volume", "turnover", "open_interest"]


def normalize_bars(rows: DataFrame, symbol: str, exchange: str, timeframe: str) -> DataFrame:
    """Text columns under their own or other names to bars; missing volume, open interest and turnover are 0.

    A missing required column or an unreadable required value is an error.
    """
    given = {c.strip().lower(): c for c in rows.columns}
    cols = {}
    for name, others in ALIASES.items():
        found = next((given[x] for x in (name, *others) if x in given), None)
        if found is None and name in REQUIRED:
            raise ValueError(f"no column {name}")
        value = F.lit(None) if found is None else S.parse_datetime(found) if name == "datetime" else F.expr(f"try_cast(trim(`{found}`) as double)")
        bad = F.raise_error(F.concat(F.lit(f"unreadable {name}: "), F.coalesce(F.col(found), F.lit("")))) if found else None
        cols[name] = F.coalesce(value, bad.cast("timestamp" if name == "datetime" else "double")) if name in REQUIRED else F.coalesce(value.cast("double"), F.lit(0.0))
    label = S.ALIASES[timeframe.strip().lower()]
    return rows.select(F.lit(symbol).alias("symbol"), F.lit(exchange).alias("exchange"), F.lit(label).alias("timeframe"), *[cols[c].alias(c) for c in BAR[3:]])


def csv_bars(spark: SparkSession, path: str, symbol: str, exchange: str, timeframe: str, max_rows: int | None = None) -> DataFrame:
    """Bars of CSV files with a header; max_rows: the first rows by datetime."""
    out = normalize_bars(spark.read.option("header", True).option("inferSchema", False).csv(path), symbol, exchange, timeframe)
    return out.orderBy("datetime").limit(max_rows) if max_rows is not None else out


def csv_prices(spark: SparkSession, path: str, symbol: str, exchange: str, timeframe: str) -> DataFrame:
    """Bars of CSV files with only times and prices taken; the rest is 0."""
    zero = F.lit(0.0)
    return csv_bars(spark, path, symbol, exchange, timeframe).withColumns({"volume": zero, "open_interest": zero, "turnover": zero})


def csv_positional(spark: SparkSession, path: str, symbol: str, exchange: str, timeframe: str, header: bool = True) -> DataFrame:
    """Bars of CSV files whose eight columns have their places; a row of another length is an error."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in POSITIONS])
    rows = spark.read.schema(schema).option("header", header).option("mode", "FAILFAST").option("enforceSchema", True).csv(path)
    return normalize_bars(rows, symbol, exchange, timeframe)


def parse_pipe(lines: DataFrame, column: str = "value") -> DataFrame:
    """Minute bars from lines ms|symbol|exchange|open|high|low|close|volume|oi|turnover; other lines are skipped."""
    p = F.split(F.col(column), r"\|")

    def number(i: int):
        return F.get(p, F.lit(i)).try_cast("double")

    at = F.timestamp_millis(F.get(p, F.lit(0)).try_cast("long"))
    names = ["open_price", "high_price", "low_price", "close_price", "volume", "open_interest", "turnover"]
    cols = [F.get(p, F.lit(1)).alias("symbol"), F.get(p, F.lit(2)).alias("exchange"), F.lit("m1").alias("timeframe"), at.alias("datetime")]
    out = lines.where(F.size(p) == 10).select(*cols, *[number(i + 3).alias(c) for i, c in enumerate(names)])
    return out.where(" and ".join(f"{c} is not null" for c in ("datetime", *names)))


def pipe_bars(spark: SparkSession, path: str) -> DataFrame:
    return parse_pipe(spark.read.text(path))


def parse_trades(messages: DataFrame, column: str = "value", first_symbol: str | None = None) -> DataFrame:
    """Minute-bar rows of trade messages, bare or wrapped in `data`; messages without price or time are dropped.

    A message with `data` is that object alone: what stands beside it doesn't count.
    """
    payload = F.coalesce(F.get_json_object(column, "$.data"), F.col(column))

    def get(key: str):
        return F.get_json_object(payload, f"$.{key}")

    price, size = get("p").try_cast("double"), F.coalesce(get("q").try_cast("double"), F.lit(0.0))
    at = F.timestamp_millis(F.coalesce(get("T").try_cast("long"), get("E").try_cast("long")))
    rows = messages.select(F.coalesce(get("s"), F.lit(first_symbol)).alias("symbol"), F.lit("BINANCE").alias("exchange"), F.lit("m1").alias("timeframe"), at.alias("datetime"), price.alias("price"), size.alias("size"))
    rows = rows.where("price is not null and datetime is not null and symbol is not null")
    prices = [F.col("price").alias(f"{x}_price") for x in ("open", "high", "low", "close")]
    return rows.select("symbol", "exchange", "timeframe", "datetime", *prices, F.col("size").alias("volume"), F.lit(0.0).alias("open_interest"), (F.col("price") * F.col("size")).alias("turnover"))


#: start price, close step, high and low distance, volume, open interest, seconds a bar; fixed values.
FEEDS = {"ctp": (100.0, 0.2, 0.4, 0.3, 1000.0, 5000.0, 60), "mock": (100.0, 0.2, 0.4, 0.3, 1000.0, 5000.0, 60), "crypto": (100.0, 0.1, 0.2, 0.2, 800.0, 0.0, 1)}


def synthetic_bars(spark: SparkSession, n: int, feed: str = "ctp", symbol: str = "I2601", exchange: str = "SIM", start: str = "2024-01-01 00:00:00") -> DataFrame:
    """n bars of a feed that rises by a step each bar."""
    base, step, up, down, volume, oi, seconds = FEEDS[feed]
    opened = F.lit(base) + F.col("id") * step
    closed = opened + step
    at = F.to_timestamp(F.lit(start)) + F.make_dt_interval(secs=(F.col("id") + 1) * seconds)
    rows = spark.range(n).select(F.lit(symbol).alias("symbol"), F.lit(exchange).alias("exchange"), F.lit("m1").alias("timeframe"), at.alias("datetime"), opened.alias("open_price"), (closed + up).alias("high_price"), (opened - down).alias("low_price"), closed.alias("close_price"), F.lit(volume).alias("volume"), F.lit(oi).alias("open_interest"))
    return rows.withColumn("turnover", F.col("volume") * F.col("close_price"))


def bootstrap_bars(spark: SparkSession, n: int, symbol: str = "I2601", exchange: str = "SIM", start: str = "2024-01-01 00:00:00") -> DataFrame:
    """n bars to warm a feed up with."""
    i, base = F.col("id"), F.lit(100.0) + F.col("id") * 0.2
    at = F.to_timestamp(F.lit(start)) + F.make_dt_interval(mins=i)
    rows = spark.range(n).select(F.lit(symbol).alias("symbol"), F.lit(exchange).alias("exchange"), F.lit("m1").alias("timeframe"), at.alias("datetime"), base.alias("open_price"), (base + 0.6).alias("high_price"), (base - 0.4).alias("low_price"), (base + 0.2).alias("close_price"), (1000.0 + 10.0 * i).alias("volume"), (5000.0 + 8.0 * i).alias("open_interest"))
    return rows.withColumn("turnover", F.col("volume") * F.col("close_price"))


def merged_replay(parts: list[DataFrame]) -> DataFrame:
    """Bars of several timeframes in replay order: by time, then by timeframe."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy("datetime", S.timeframe_minutes("timeframe"))


_SYMBOL = "asset_type string, code string, name string, exchange string, tick_size double, price_precision int, currency string, product string, multiplier double, margin_rate double, fee_rate double"


def _document(path: str):
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError:
            return simple_yaml(open(path, encoding="utf-8").read())
        return yaml.safe_load(open(path, encoding="utf-8"))
    if path.endswith(".json"):
        return json.load(open(path, encoding="utf-8"))
    raise ValueError(f"unsupported file: {path}")


def simple_yaml(text: str) -> dict:
    """Nested maps of scalars, by indentation: what configuration files here use."""
    root: dict = {}
    stack = [(-1, root)]
    for line in text.splitlines():
        line = line.split(" #")[0].rstrip()
        if not line.strip() or line.lstrip().startswith(("#", "---")):
            continue
        depth, (key, _, value) = len(line) - len(line.lstrip()), line.strip().partition(":")
        key, value = key.strip("'\" "), value.strip().strip("'\"")
        while stack[-1][0] >= depth:
            stack.pop()
        if value:
            try:
                stack[-1][1][key] = float(value)
            except ValueError:
                stack[-1][1][key] = None if value in ("null", "~") else value
        else:
            stack[-1][1][key] = {}
            stack.append((depth, stack[-1][1][key]))
    return root


def symbols(spark: SparkSession, path: str) -> DataFrame:
    """The symbol dimension of a JSON or YAML map; a row for each code, the last of a code wins."""
    by_code = {v["code"]: v for v in _document(path).values()}
    names = [x.split()[0] for x in _SYMBOL.split(", ")]
    kinds = {x.split()[0]: x.split()[1] for x in _SYMBOL.split(", ")}
    cast = {"double": float, "int": int, "string": str}
    rows = [tuple(None if v.get(k) is None else cast[kinds[k]](v[k]) for k in names) for v in by_code.values()]
    return spark.createDataFrame(rows, _SYMBOL)


def supply_config(path: str):
    """The supply/demand configuration of a file that patches the defaults."""
    from barline.operators.supply import SupplyConfig

    return SupplyConfig().patched(_document(path))


def supply_profile(path: str):
    """The four levels of a profile file."""
    from barline.operators.supply import SupplyProfile

    found = _document(path)
    return SupplyProfile(found.get("default"), found.get("timeframes"), found.get("symbols"), found.get("symbol_timeframes"))


def environment(env: Mapping[str, str] | None = None, prefix: str = "BARLINE_") -> dict:
    """Runtime settings from the environment: mode, symbols, capacities and overload policy, with defaults."""
    env = os.environ if env is None else env

    def number(name: str, default: int) -> int:
        text = env.get(prefix + name, "")
        return int(text) if text.isdigit() and int(text) > 0 else default

    names = [x.strip() for x in env.get(prefix + "SYMBOLS", "").split(",")]
    policy = env.get(prefix + "MARKET_OVERLOAD", "drop_oldest").strip().lower()
    return {
        "mode": env.get(prefix + "MODE", "ctp").strip().lower(),
        "symbols": list(dict.fromkeys(x for x in names if x)) or ["I2601"],
        "channel_capacity": number("MARKET_CHANNEL_CAPACITY", 8192),
        "ingress_capacity": number("MARKET_INGRESS_CAPACITY", 16384),
        "overload": policy if policy in ("drop_oldest", "drop_newest") else "drop_oldest",
    }
