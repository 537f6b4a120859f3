"""Scalar functions of bars, zones, symbols and times, as Column expressions.

Directions are 1 (up), -1 (down) and 0; fractals are 1 (top), -1 (bottom) and 0.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 2.220446049250313e-16

#: Labels of timeframes and their minutes; fixed values.
MINUTES = {"m1": 1, "m5": 5, "m15": 15, "h1": 60, "d1": 1440}
ALIASES = {"1m": "m1", "5m": "m5", "15m": "m15", "1h": "h1", "60m": "h1", "1d": "d1"} | {k: k for k in MINUTES}


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def rsign(x: Column | str) -> Column:
    """-1 below zero, else 1; zero counts as positive."""
    return F.when(_c(x) < 0, F.lit(-1.0)).otherwise(F.lit(1.0))


def clamp(x: Column | str, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), _c(x)))


def safe_div(n: Column | str, d: Column | str) -> Column:
    """0 where the denominator is about 0."""
    return F.when(F.abs(_c(d)) < EPSILON, F.lit(0.0)).otherwise(_c(n) / _c(d))


def approx_equal(a: Column | str, b: Column | str) -> Column:
    return F.abs(_c(a) - _c(b)) <= EPSILON


def body() -> Column:
    return F.abs(F.col("close_price") - F.col("open_price"))


def upper_shadow() -> Column:
    return F.col("high_price") - F.greatest("close_price", "open_price")


def lower_shadow() -> Column:
    return F.least("close_price", "open_price") - F.col("low_price")


def total_range() -> Column:
    return F.col("high_price") - F.col("low_price")


def is_inclusive(high_a, low_a, high_b, low_b) -> Column:
    """Whether either range contains the other, edges included."""
    a, b, c, d = _c(high_a), _c(low_a), _c(high_b), _c(low_b)
    return ((a >= c) & (b <= d)) | ((a <= c) & (b >= d))


def overlaps(low_a, high_a, low_b, high_b, touch: bool = True) -> Column:
    """Whether two ranges meet; touch: a common edge is enough."""
    low, high = F.greatest(_c(low_a), _c(low_b)), F.least(_c(high_a), _c(high_b))
    return low <= high if touch else low < high


def fractal_code(left: tuple, middle: tuple, right: tuple) -> Column:
    """1 for a top, -1 for a bottom, 0 otherwise or at an end; arguments are (high, low). A tie of both is a top."""
    (lh, ll), (mh, ml), (rh, rl) = [tuple(map(_c, x)) for x in (left, middle, right)]
    top = (mh >= lh) & (mh >= rh) & (ml >= ll) & (ml >= rl)
    bottom = (mh <= lh) & (mh <= rh) & (ml <= ll) & (ml <= rl)
    return F.when(lh.isNull() | rh.isNull(), 0).when(top, 1).when(bottom, -1).otherwise(0)


def opposite(direction: Column | str) -> Column:
    """The other way of up or down; 0 for anything else."""
    return F.when(_c(direction) == 1, -1).when(_c(direction) == -1, 1).otherwise(0)


def timeframe(label: Column | str) -> Column:
    """The canonical label; an unknown one is an error."""
    key = F.lower(F.trim(_c(label)))
    known = F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])
    return F.coalesce(F.try_element_at(known, key), F.raise_error(F.concat(F.lit("unsupported timeframe: "), key)).cast("string"))


def timeframe_minutes(label: Column | str) -> Column:
    known = F.create_map(*[F.lit(x) for kv in MINUTES.items() for x in kv])
    return F.try_element_at(known, _c(label))


def parse_datetime(text: Column | str) -> Column:
    """A UTC timestamp from the accepted formats; text in none of them is null."""
    c = F.trim(_c(text))
    stamp = F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}T.*(Z|[+-]\d{2}:\d{2})$"), F.try_to_timestamp(c))
    fraction = F.coalesce(F.nullif(F.regexp_extract(c, r"\.(\d+)$", 1), F.lit("")), F.lit("0"))
    micros = F.rpad(F.substring(fraction, 1, 6), 6, "0").cast("int")
    whole = F.regexp_replace(c, r"\.\d+$", "")
    plain = F.coalesce(*[F.try_to_timestamp(whole, F.lit(f)) for f in ("yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd HH:mm:ss", "yyyyMMddHHmmss", "yyyy-MM-dd")])
    return F.coalesce(stamp, F.timestamp_micros(F.unix_micros(plain) + micros))


def counter_delta(now: Column | str, before: Column | str) -> Column:
    """Growth of a cumulative counter; 0 at the first value and where it was reset."""
    return F.when(_c(before).isNull() | (_c(now) < _c(before)), 0.0).otherwise(_c(now) - _c(before))


def zone_contains(price: Column | str) -> Column:
    return _c(price).between(F.col("lower"), F.col("upper"))


def signed_strength(direction="direction", behavior="behavior", strength="strength") -> Column:
    """Strength with the sign of the direction, turned for rejections and failures, within -1 and 1."""
    side = F.when(_c(behavior).isin("strong_accept", "weak_accept", "second_push"), 1.0).otherwise(-1.0)
    way = F.when(_c(direction) == 1, 1.0).when(_c(direction) == -1, -1.0).otherwise(0.0)
    return clamp(way * side * _c(strength), -1, 1)


def round_price(price, tick_size, precision) -> Column:
    """To a whole number of ticks, then to decimals; halves away from zero."""
    scale = F.pow(F.lit(10.0), _c(precision))
    return F.round(F.round(_c(price) / _c(tick_size)) * _c(tick_size) * scale) / scale


def anchor_price(fractal, direction, is_start: Column) -> Column:
    """A top's high, a bottom's low, else by direction and end of a segment, else the middle."""
    high, low = F.col("high_price"), F.col("low_price")
    d = _c(direction)
    up = ((d == 1) & ~is_start) | ((d == -1) & is_start)
    down = ((d == 1) & is_start) | ((d == -1) & ~is_start)
    return F.when(_c(fractal) == 1, high).when(_c(fractal) == -1, low).when(up, high).when(down, low).otherwise((high + low) / 2)


def channel_key(symbol, interval_seconds) -> Column:
    return F.concat_ws(":", F.lower(_c(symbol)), _c(interval_seconds).cast("string"))


def tick_key(symbol="symbol", exchange="exchange") -> Column:
    return F.concat_ws("::", _c(symbol), _c(exchange))


def shard(key, n_shards: int) -> Column:
    """A shard of n; stable, but specific to this engine's hash."""
    return F.pmod(F.xxhash64(_c(key)), F.lit(n_shards)).cast("int")


def shard_count(cpus: int) -> int:
    return max(8, min(128, 2 * cpus))


def score_direction(score) -> Column:
    return F.when(_c(score) > 0.2, 1).when(_c(score) < -0.2, -1).otherwise(0)


def split_symbols(text, default: str = "I2601") -> Column:
    """A comma-separated list, trimmed, without blanks and repeats, in order; the default if none is left."""
    parts = F.array_distinct(F.filter(F.transform(F.split(_c(text), ","), lambda x: F.trim(x)), lambda x: x != ""))
    return F.when(F.coalesce(F.size(parts), F.lit(0)) > 0, parts).otherwise(F.array(F.lit(default)))


def stream_endpoint(base: str, symbols) -> Column:
    """Address of the trade streams of symbols: sorted, without repeats; one stream has the plain form."""
    names = F.array_sort(F.array_distinct(F.transform(_c(symbols), lambda s: F.concat(F.lower(F.trim(s)), F.lit("@trade")))))
    one = F.concat(F.lit(f"{base}/ws/"), F.element_at(names, 1))
    return F.when(F.size(names) == 1, one).otherwise(F.concat(F.lit(f"{base}/stream?streams="), F.array_join(names, "/")))


def backoff_ms(attempt, initial_ms, max_ms) -> Column:
    """Doubles with each attempt, up to 2**10 times and the maximum."""
    doubled = _c(initial_ms) * F.pow(F.lit(2.0), F.least(F.greatest(_c(attempt) - 1, F.lit(0)), F.lit(10)))
    return F.least(doubled, F.greatest(_c(max_ms), _c(initial_ms))).cast("long")


def normalize_key(text) -> Column:
    return F.lower(F.trim(_c(text)))


def display_time(ts, with_clock: bool = True) -> Column:
    """Month and day, and the clock, eight hours east of UTC."""
    return F.date_format(_c(ts) + F.expr("interval 8 hours"), "MM-dd HH:mm" if with_clock else "MM-dd")


def label(code, names: dict[int, str], other: str = "none") -> Column:
    out = None
    for k, v in names.items():
        out = F.when(_c(code) == k, v) if out is None else out.when(_c(code) == k, v)
    return out.otherwise(other) if out is not None else F.lit(other)


FRACTALS = {1: "top", -1: "bottom"}
DIRECTIONS = {1: "up", -1: "down", 2: "range"}
SWING_STATES = {0: "forming", 1: "pending_reverse", 2: "confirmed"}


def time_ordered_id(ts, worker: int, sequence) -> Column:
    """Milliseconds since 2025, a worker and a sequence number in one long; for exchange with other systems only."""
    millis = F.unix_millis(_c(ts)) - F.lit(1735689600000)
    return F.shiftleft(millis, 22).bitwiseOR(F.lit(worker << 12).cast("long")).bitwiseOR(_c(sequence).cast("long"))
