"""The driver's tables as ticks, bars and configuration, with the same inputs as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barline.operators import bars as B


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose times, stored without a zone, are UTC; the session's zone is UTC as everywhere here."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return rows.withColumns({f.name: F.col(f.name).cast("timestamp") for f in rows.schema if f.dataType.typeName() == "timestamp_ntz"})


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event stream as ticks: a symbol for each event type, cumulative volume and turnover, users as open interest."""
    w = W.partitionBy("event_type").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)
    cents = F.round(F.col("value") * 100).cast("long")
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"),
        F.lit("SIM").alias("exchange"),
        F.col("ts").alias("datetime"),
        "event_id",
        F.col("value").alias("last_price"),
        F.count("*").over(w).cast("double").alias("volume"),
        (F.sum(cents).over(w).cast("double") / 100.0).alias("turnover"),
        F.col("user_id").cast("double").alias("open_interest"),
    )


def walk(spark: SparkSession, sf_dir: str, unit: str = "hour", label: str = "h1") -> DataFrame:
    """Clock bars of a price that rises or falls with each event's value, by the user's parity: it has swings and trends."""
    w = W.partitionBy("symbol").orderBy("datetime", "event_id").rowsBetween(W.unboundedPreceding, 0)
    step = F.when(F.col("open_interest") % 2 == 0, 1).otherwise(-1) * F.round(F.col("last_price") * 100).cast("long")
    rows = plain_ticks(spark, sf_dir).withColumn("last_price", F.lit(10000.0) + F.sum(step).over(w).cast("double") / 100.0)
    return B.clock_bars(rows, unit, label)


TICKS = """ticks AS (
  SELECT event_type AS symbol, 'SIM' AS exchange, ts AS datetime, event_id, value AS last_price,
         CAST(count(*) OVER w AS DOUBLE) AS volume,
         CAST(sum(CAST(round(value * 100) AS BIGINT)) OVER w AS DOUBLE) / 100.0 AS turnover,
         CAST(user_id AS DOUBLE) AS open_interest
  FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))"""


def plain_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticks without the cumulative columns, for bars that don't need them: no window, no sort."""
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), F.lit("SIM").alias("exchange"), F.col("ts").alias("datetime"), "event_id", F.col("value").alias("last_price"), F.col("user_id").cast("double").alias("open_interest"))


def clock(spark: SparkSession, sf_dir: str, unit: str = "hour", label: str = "h1") -> DataFrame:
    return B.clock_bars(plain_ticks(spark, sf_dir), unit, label)


def clock_sql(unit: str = "hour", label: str = "h1") -> str:
    return f"""{label} AS (
  SELECT symbol, exchange, '{label}' AS timeframe, row_number() OVER (PARTITION BY symbol ORDER BY begun) AS id, begun AS datetime,
         open_price, high_price, low_price, close_price, volume, open_interest, turnover
  FROM (SELECT event_type AS symbol, 'SIM' AS exchange, date_trunc('{unit}', ts) AS begun,
               arg_min(value, event_id) AS open_price, max(value) AS high_price, min(value) AS low_price, arg_max(value, event_id) AS close_price,
               CAST(count(*) AS DOUBLE) AS volume, CAST(arg_max(user_id, event_id) AS DOUBLE) AS open_interest,
               CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / 100.0 AS turnover
        FROM events GROUP BY ALL))"""


M1 = f"""{TICKS},
deltas AS (
  SELECT *, date_trunc('minute', datetime) AS minute,
         CASE WHEN lag(volume) OVER w IS NULL OR volume < lag(volume) OVER w THEN 0.0 ELSE volume - lag(volume) OVER w END AS volume_delta,
         CASE WHEN lag(turnover) OVER w IS NULL OR turnover < lag(turnover) OVER w THEN 0.0 ELSE turnover - lag(turnover) OVER w END AS turnover_delta,
         coalesce(CAST(date_trunc('minute', datetime) <> lag(date_trunc('minute', datetime)) OVER w AS INT), 0) AS change
  FROM ticks WINDOW w AS (PARTITION BY symbol ORDER BY datetime, event_id)),
islands AS (SELECT *, sum(change) OVER (PARTITION BY symbol ORDER BY datetime, event_id ROWS UNBOUNDED PRECEDING) AS island FROM deltas),
m1 AS (
  SELECT symbol, exchange, 'm1' AS timeframe, CAST(island + 1 AS BIGINT) AS id, min(minute) AS datetime,
         arg_min(last_price, event_id) AS open_price, max(last_price) AS high_price, min(last_price) AS low_price, arg_max(last_price, event_id) AS close_price,
         sum(volume_delta) AS volume, arg_max(open_interest, event_id) AS open_interest, sum(turnover_delta) AS turnover
  FROM islands GROUP BY symbol, exchange, island)"""


def m1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.tick_to_m1(ticks(spark, sf_dir))


def count_sql(label: str, n: int) -> str:
    return f"""{label} AS (
  SELECT symbol, exchange, '{label}' AS timeframe, CAST(g + 1 AS BIGINT) AS id, arg_max(datetime, id) AS datetime,
         arg_min(open_price, id) AS open_price, max(high_price) AS high_price, min(low_price) AS low_price, arg_max(close_price, id) AS close_price,
         sum(volume) AS volume, arg_max(open_interest, id) AS open_interest, sum(turnover) AS turnover
  FROM (SELECT *, (id - 1) // {n} AS g FROM m1) GROUP BY symbol, exchange, g HAVING count(*) = {n})"""


#: Merged bars: the state is a stack of finished rows and the running one; a step pops the stack or takes the next bar.
FOLD = """fold(sym, i, st, cs, ce, h, l) AS (
  SELECT symbol, id, [{'h': high_price, 'l': low_price, 's': id, 'e': id}][:0], id, id, high_price, low_price FROM h1 WHERE id = 1
  UNION ALL
  SELECT f.sym, CASE WHEN f.inc THEN f.i ELSE f.i + 1 END,
         CASE WHEN f.inc THEN f.st[:-2] ELSE list_append(f.st, {'h': f.h, 'l': f.l, 's': f.cs, 'e': f.ce}) END,
         CASE WHEN f.inc THEN f.st[-1].s ELSE b.id END, CASE WHEN f.inc THEN f.ce ELSE b.id END,
         CASE WHEN f.inc THEN greatest(f.h, f.st[-1].h) ELSE b.high_price END, CASE WHEN f.inc THEN least(f.l, f.st[-1].l) ELSE b.low_price END
  FROM (SELECT *, len(st) > 0 AND ((st[-1].h >= h AND st[-1].l <= l) OR (st[-1].h <= h AND st[-1].l >= l)) AS inc FROM fold) f
  LEFT JOIN h1 b ON b.symbol = f.sym AND b.id = f.i + 1
  WHERE f.inc OR b.id IS NOT NULL),
done AS (SELECT *, row_number() OVER (PARTITION BY sym ORDER BY i DESC, len(st)) AS rn FROM fold),
flat AS (SELECT sym, unnest(list_append(st, {'h': h, 'l': l, 's': cs, 'e': ce})) AS x FROM done WHERE rn = 1),
cbar AS (SELECT sym AS symbol, 'SIM' AS exchange, 'h1' AS timeframe, row_number() OVER (PARTITION BY sym ORDER BY x.s) AS id,
                x.s AS sbar_start_id, x.e AS sbar_end_id, x.h AS high_price, x.l AS low_price FROM flat)"""


def with_cbars(body: str) -> str:
    return f"WITH RECURSIVE {clock_sql()},\n{FOLD}\n{body}"


def fractal_sql(source: str) -> str:
    """labelled: source with fractal_type and its neighbours' prices."""
    return f"""labelled AS (
  SELECT *, CASE WHEN lh IS NULL OR rh IS NULL THEN 0
                 WHEN high_price >= lh AND high_price >= rh AND low_price >= ll AND low_price >= rl THEN 1
                 WHEN high_price <= lh AND high_price <= rh AND low_price <= ll AND low_price <= rl THEN -1 ELSE 0 END AS fractal_type
  FROM (SELECT *, lag(high_price) OVER w AS lh, lag(low_price) OVER w AS ll, lead(high_price) OVER w AS rh, lead(low_price) OVER w AS rl
        FROM {source} WINDOW w AS (PARTITION BY symbol, exchange, timeframe ORDER BY id)))"""


#: Segments of twenty hourly bars with alternating direction, in the columns of swings.
def blocks(spark: SparkSession, sf_dir: str, size: int = 20) -> DataFrame:
    rows = clock(spark, sf_dir).groupBy("symbol", "exchange", "timeframe", (F.floor((F.col("id") - 1) / size) + 1).alias("block")).agg(F.min("id").alias("sbar_start_id"), F.max("id").alias("sbar_end_id"), F.max("high_price").alias("high_price"), F.min("low_price").alias("low_price"), F.sum("volume").alias("volume"), F.min_by("open_interest", "id").alias("start_oi"), F.max_by("open_interest", "id").alias("end_oi"))
    number = F.col("block").cast("long")
    return rows.select("symbol", "exchange", "timeframe", number.alias("id"), F.when(number % 2 == 1, 1).otherwise(-1).alias("direction"), number.alias("cbar_start_id"), number.alias("cbar_end_id"), "sbar_start_id", "sbar_end_id", "high_price", "low_price", F.lit(1).alias("span"), "volume", "start_oi", "end_oi", F.lit(2).alias("state"))


BLOCKS = """blocks AS (
  SELECT symbol, exchange, timeframe, (id - 1) // 20 + 1 AS id, CASE WHEN ((id - 1) // 20 + 1) % 2 = 1 THEN 1 ELSE -1 END AS direction,
         min(id) AS sbar_start_id, max(id) AS sbar_end_id, max(high_price) AS high_price, min(low_price) AS low_price,
         sum(volume) AS volume, arg_min(open_interest, id) AS start_oi, arg_max(open_interest, id) AS end_oi
  FROM (SELECT *, id AS bar FROM h1) GROUP BY symbol, exchange, timeframe, (id - 1) // 20)"""
