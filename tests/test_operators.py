import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from barline.functions import scalars as S
from barline.operators import bars as B
from barline.operators import decision, routing, structure, supply, zones
from tests import gen


def frame(spark, rows):
    return spark.createDataFrame(rows, gen.BAR)


def first(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("x, expected", [(0.0, 1.0), (-0.0, 1.0), (-2.0, -1.0), (3.0, 1.0)])
def test_rsign_takes_zero_as_positive(spark, x, expected):
    assert first(spark, S.rsign(F.lit(x))) == expected


def test_unknown_timeframe_is_an_error(spark):
    with pytest.raises(Exception, match="unsupported timeframe"):
        spark.createDataFrame([("7m",)], "k string").select(S.timeframe("k")).collect()


def test_round_price_halves_away_from_zero(spark):
    assert first(spark, S.round_price(F.lit(-2.5), F.lit(1.0), F.lit(0))) == -3.0
    assert first(spark, S.round_price(F.lit(10.07), F.lit(0.05), F.lit(2))) == 10.05


@pytest.mark.parametrize("a, b, touch, cross", [((90, 120), (79, 95), True, True), ((90, 120), (78, 90), True, False), ((1, 2), (3, 4), False, False)])
def test_overlap(spark, a, b, touch, cross):
    args = [F.lit(x) for x in (*a, *b)]
    assert first(spark, S.overlaps(*args)) == touch and first(spark, S.overlaps(*args, touch=False)) == cross


def test_signed_strength(spark):
    rows = spark.createDataFrame([(1, "strong_accept", 0.8), (1, "strong_reject", 0.8), (-1, "second_push", 0.5), (0, "weak_accept", 1.0)], "direction int, behavior string, strength double")
    assert [r[0] for r in rows.select(S.signed_strength()).collect()] == [0.8, -0.8, -0.5, 0.0]


TICK = "symbol string, exchange string, datetime timestamp, event_id long, last_price double, volume double, turnover double, open_interest double"


def test_tick_to_minute_bar(spark):
    rows = [("S", "X", datetime(2024, 1, 1, 9, 0, 10), 1, 100.0, 10.0, 1000.0, 200.0), ("S", "X", datetime(2024, 1, 1, 9, 1, 10), 2, 101.0, 20.0, 2100.0, 210.0)]
    ticks = spark.createDataFrame(rows, TICK)
    closed = B.tick_to_m1(ticks, flush=False).collect()
    assert [(r["open_price"], r["close_price"], r["volume"], r["open_interest"]) for r in closed] == [(100.0, 100.0, 0.0, 200.0)]
    last = B.tick_to_m1(ticks).orderBy("id").collect()[1]
    assert (last["volume"], last["turnover"]) == (10.0, 1100.0)


def test_bad_prices_are_dropped_and_resets_count_nothing(spark):
    rows = [("S", "X", datetime(2024, 1, 1, 9, 0, s), s, p, v, v, 0.0) for s, p, v in [(1, 5.0, 10.0), (2, None, 11.0), (3, float("nan"), 12.0), (4, 6.0, 3.0), (5, 7.0, 8.0)]]
    r = B.tick_to_m1(spark.createDataFrame(rows, TICK)).collect()
    assert len(r) == 1 and (r[0]["high_price"], r[0]["volume"]) == (7.0, 5.0)


def test_count_windows_keep_whole_groups_only(spark):
    m1 = frame(spark, gen.bars([(i, i + 1, i - 1, i, 1, i) for i in range(1, 13)])).withColumn("timeframe", F.lit("m1"))
    found = B.count_window(m1, "m5").orderBy("id").collect()
    assert [(r["id"], r["datetime"].minute, r["open_price"], r["close_price"], r["volume"]) for r in found] == [(1, 5, 1.0, 5.0, 5.0), (2, 10, 6.0, 10.0, 5.0)]
    assert B.fan_out(m1, ["5m"]).count() == 2 and B.fan_out(m1, ["m1", "5m"]).count() == 14


def test_structure_frames_match_the_cores_and_series_stay_apart(spark):
    bars = frame(spark, gen.walk(1) + gen.walk(2, symbol="RB"))
    merged = structure.cbars(bars)
    assert structure.range_verify(bars, merged).where("not (range_ok and single_ok)").count() == 0
    assert structure.inclusive_pairs(merged).count() == 0
    assert structure.cbar_of_each_bar(bars, merged).count() == bars.count()
    done = structure.swings(bars).where("state = 2")
    assert {r["symbol"] for r in done.select("symbol").distinct().collect()} == {"I2601", "RB"}
    whole = [tuple(r) for r in structure.swings(bars).where("symbol = 'RB'").collect()]
    alone = [tuple(r) for r in structure.swings(frame(spark, gen.walk(2, symbol="RB"))).collect()]
    assert sorted(whole) == sorted(alone)


def test_fractals_are_local_and_ends_have_none(spark):
    rows = structure.label_fractals(structure.cbars(frame(spark, gen.walk(3)))).orderBy("id").collect()
    assert rows[0]["fractal_type"] == rows[-1]["fractal_type"] == 0
    assert any(r["fractal_type"] == 1 for r in rows) and any(r["fractal_type"] == -1 for r in rows)
    equal = frame(spark, gen.bars([(1, 2, 0, 1, 1, 1)] * 3))
    assert [r["fractal_type"] for r in structure.label_fractals(equal).orderBy("id").collect()] == [0, 1, 0]


def test_backtrack(spark):
    old = structure.cbars(frame(spark, gen.walk(4)[:300]))
    new = structure.cbars(frame(spark, gen.walk(4)))
    a, b = ([tuple(r)[4:] for r in x.orderBy("id").collect()] for x in (old, new))
    from barline.operators.cores import first_change

    found = structure.first_changed(old, new, ["sbar_start_id", "sbar_end_id", "high_price", "low_price"]).first()
    assert found["backtrack_id"] == first_change(a, b, True)


BULL = [(100, 102, 99, 101.8, 10, 1000), (101.8, 103, 101, 102.7, 12, 1015), (102.7, 104, 102.2, 103.8, 14, 1030), (103.8, 105, 103.2, 104.7, 16, 1045)]
BEAR = [(104, 104.5, 102.5, 103, 10, 1000), (103, 103.3, 101.8, 102, 11, 1008), (102, 102.2, 100.7, 101, 12, 1016), (101, 101.2, 99.5, 100, 13, 1024)]


@pytest.mark.parametrize(
    "rows, expected",
    [
        (BULL, {"score": 0.452710, "stage": "weakening", "f1": 0.086789, "f2": 0.546512, "f3": 1.0, "f4": 0.230769, "f5": 1.0, "f6": 0.230769, "f8": 0.040278, "f9": 1.0}),
        (BEAR, {"score": -0.239743, "stage": "failed", "f1": 0.202407, "f2": -0.597015, "f3": -1.0, "f4": 0.130435, "f5": -1.0, "f6": -0.130435, "f8": -0.105392, "f9": 1.0}),
        ([(100, 100, 100, 100, 10, 0)], {"f2": 0.0, "f3": 1.0, "f9": 1.0}),
    ],
)
def test_supply_scores(spark, rows, expected):
    found = supply.latest(supply.score(frame(spark, gen.bars(rows)))).first()
    for k, v in expected.items():
        assert found[k] == (v if isinstance(v, str) else pytest.approx(v, abs=1e-6))


def test_supply_profile_and_overlay_agree(spark):
    profile = supply.SupplyProfile({"stable_threshold": 0.5}, {"H1": {"f1_weight": 0.3}}, {" click": {"stable_threshold": 0.6}}, {"*.h1": {"layer3_weight": 0.3}, "view.*": {"stable_threshold": 0.35}, "View.H1": {"f1_weight": 0.2, "nonsense": 1}})
    patches = [("default", "", 0.5, None, None), ("timeframe", "H1", None, 0.3, None), ("symbol", " click", 0.6, None, None), ("symbol_timeframe", "*.h1", None, None, 0.3), ("symbol_timeframe", "view.*", 0.35, None, None), ("symbol_timeframe", "View.H1", None, 0.2, None)]
    table = spark.createDataFrame(patches, "level string, key string, stable_threshold double, f1_weight double, layer3_weight double")
    rows = spark.createDataFrame([("view", "h1"), ("click", "h1"), ("view", "m5"), ("other", "d1")], "symbol string, timeframe string")
    for r in supply.overlay(rows, table).collect():
        assert supply.SupplyConfig(**r["cfg"].asDict()) == profile.resolve(r["symbol"], r["timeframe"])


def test_zone_refinement_is_the_scan_over_the_whole_grid(spark):
    rows = gen.cycle("keyzone")
    bars = frame(spark, rows)
    spans = [(10, 18), (19, 27), (28, 36), (37, 45), (46, 54), (55, 63)]
    segments = [("I2601", "DCE", "m15", i, 1 if i % 2 else -1, a, b, 105.0, 98.0) for i, (a, b) in enumerate(spans, 1)]
    schema = "symbol string, exchange string, timeframe string, id long, direction int, sbar_start_id long, sbar_end_id long, high_price double, low_price double"
    found = zones.zones(spark.createDataFrame(segments, schema), None, bars).orderBy("zone_id").collect()
    assert len(found) == 5 and [r["sbar_start_id"] for r in found] == [55, 46, 37, 28, 19]
    for z in found:
        scope = [r for r in rows if z["sbar_start_id"] <= r[3] <= z["sbar_end_id"]]
        steps = [s for r in scope for s in (r[6] - r[7], abs(r[8] - r[5]), r[6] - r[5], abs(r[7] - r[5])) if s > 1e-9]
        tick = max(min(steps) / 10, 1e-4)
        low, high = (min(max(r[5], r[8]) for r in scope), max(r[6] for r in scope)) if z["direction"] == 1 else (min(r[7] for r in scope), max(min(r[5], r[8]) for r in scope))
        best = max(range(int((high + tick / 2 - low) / tick) + 1), key=lambda k: (sum(r[7] <= low + k * tick <= r[6] for r in scope), -k))
        price, touches = low + best * tick, sum(r[7] <= low + best * tick <= r[6] for r in scope)
        bound = z["lower"] if z["direction"] == 1 else z["upper"]
        assert z["touch_count"] == touches and bound == pytest.approx(price, abs=2 * tick)
        assert z["upper"] >= z["lower"] and z["last_touch_id"] == z["sbar_end_id"]
    none = zones.zones(spark.createDataFrame([("I2601", "DCE", "m15", 1, 1, 900, 901, 105.0, 98.0)], schema), None, bars).first()
    assert (none["lower"], none["upper"], none["touch_count"], none["last_touch_id"]) == (98.0, 105.0, 0, None)


ZONE = "symbol string, exchange string, timeframe string, zone_id int, direction int, lower double, upper double, touch_count int"


@pytest.mark.parametrize(
    "bar, before, expected",
    [
        ((101, 104, 100, 103), (107, 108, 106), "breakout_failure"),
        ((101, 104, 100, 103), (101, 103, 99), "second_push"),
        ((101, 104.5, 100.5, 104), None, "strong_accept"),
        ((101, 101.4, 100.9, 101.1), None, "weak_accept"),
        ((101, 101.5, 98, 99), None, "strong_reject"),
        ((102, 103, 101, 101.9), None, "weak_reject"),
        ((90, 91, 89, 90), None, None),
        ((90, 100, 89, 95), None, None),
    ],
)
def test_reactions(spark, bar, before, expected):
    zone = spark.createDataFrame([("S", "X", "m5", 1, 1, 100.0, 105.0, 2)], ZONE)
    o, h, l, c = map(float, bar)
    pc, ph, pl = map(float, before) if before else (None, None, None)
    row = spark.createDataFrame([("S", "X", "m5", 9, o, h, l, c, pc, ph, pl)], "symbol string, exchange string, timeframe string, id long, open_price double, high_price double, low_price double, close_price double, prev_close double, prev_high double, prev_low double")
    found = zones.reactions(zone, row).collect()
    assert [r["behavior"] for r in found] == ([expected] if expected else [])
    assert all(0 <= r["strength"] <= 1 for r in found)


def test_best_signal_prefers_the_first_zone(spark):
    rows = [("S", "X", "m5", z, "weak_accept", 1, 0.5, 9) for z in (3, 1, 2)]
    df = spark.createDataFrame(rows, "symbol string, exchange string, timeframe string, zone_id int, behavior string, direction int, strength double, sbar_id long")
    assert zones.best(df).first()["zone_id"] == 1


BASE = {"higher_direction": 1, "trade_direction": 1, "entry_direction": 1, "has_keyzone_conflict": False, "is_accept_state": True, "keyzone_behavior": "strong_accept", "keyzone_strength": 0.65, "gate_consistency": 8, "gate_conflicts": 0, "second_push_ready": True, "breakout_failure": False, "cooldown_active": False, "prefer_close_over_open": True, "position": "flat", "sd_stage": "stable", "sd_score": 0.6, "sd_dominance": 0.0, "sd_efficiency": 0.0, "sd_sustainability": 0.0}


@pytest.mark.parametrize(
    "change, action",
    [
        ({}, "buy"),
        ({"second_push_ready": False}, "wait"),
        ({"position": "long", "keyzone_behavior": "breakout_failure"}, "sell"),
        ({"gate_consistency": 5, "gate_conflicts": 3}, "wait"),
        ({"cooldown_active": True}, "wait"),
        ({"position": "short"}, "cover"),
        ({"entry_direction": 0}, "wait"),
        ({"sd_stage": "failed"}, "wait"),
        ({"higher_direction": -1, "trade_direction": -1, "entry_direction": -1, "sd_score": -0.6}, "short"),
        ({"keyzone_behavior": None, "sd_score": 0.34}, "wait"),
        ({"keyzone_behavior": None, "sd_score": 0.35}, "buy"),
        ({"prefer_close_over_open": False, "position": "short"}, "cover"),
    ],
)
def test_decisions(spark, change, action):
    row = BASE | change
    schema = ", ".join(f"{k} {'int' if type(v) is int else 'boolean' if type(v) is bool else 'double' if type(v) is float else 'string'}" for k, v in BASE.items())
    assert decision.decide(spark.createDataFrame([tuple(row.values())], schema)).first()["action"] == action


def test_context_of_missing_scores_waits(spark):
    snap = "struct<score:double,stage:string,dominance:double,efficiency:double,sustainability:double>"
    rows = spark.createDataFrame([("S", "X", None, None, (0.8, "stable", 0.1, 0.1, 0.1), "strong_accept", 0.9)], f"symbol string, exchange string, higher {snap}, trade {snap}, entry {snap}, behavior string, strength double")
    found = decision.decide(decision.context(rows)).first()
    assert (found["entry_direction"], found["higher_direction"], found["action"], found["reason"]) == (1, 0, "wait", "multi timeframe conflict")


def test_as_of_and_nearest(spark):
    left = spark.createDataFrame([("a", 5, "p"), ("a", 10, "q"), ("b", 1, "r")], "k string, t long, name string")
    right = spark.createDataFrame([("a", 5, 1), ("a", 8, 2), ("a", 12, 3)], "k string, t long, v int")
    assert {(r["name"], r["v"]) for r in decision.as_of(left, right, ["k"], "t", ["v"]).collect()} == {("p", 1), ("q", 2), ("r", None)}
    near = decision.nearest(left, right.withColumnRenamed("t", "u"), ["k"], "t", "u", "v")
    assert {(r["name"], r["v"]) for r in near.collect()} == {("p", 1), ("q", 2), ("r", None)}


@pytest.mark.parametrize("policy, kept", [("drop_oldest", 2), ("drop_newest", 1)])
def test_ring_of_one(spark, policy, kept):
    rows = spark.createDataFrame([("s", 1), ("s", 2)], "symbol string, id long")
    assert [r["id"] for r in routing.ring(rows, ["symbol"], "id", 1, policy).collect()] == [kept]
    c = routing.ring_counters(rows, ["symbol"], 1, policy).first()
    assert (c["published"], c["dropped"], c["ring_len"]) == (2, 1, 1)


def test_registry(spark):
    both = structure.Indicators()
    make = lambda b: structure.ema(b, 5)
    assert both.register("fast", make) and not both.register("fast", lambda b: structure.ema(b, 9))
    both.register("range", lambda b: structure.atr(b, 3))
    out = both.apply(frame(spark, gen.cycle("cbar")))
    assert out.columns[-2:] == ["fast", "range"] and out.count() == 120 and out.where("fast is null").count() == 0


def test_frames_to_the_end_of_a_series_stay_linear(spark):
    """Four times the rows of one series take less than six times as long."""

    def seconds(n):
        rows = spark.range(1, n + 1).selectExpr("'a' as symbol", "'x' as exchange", "'h1' as timeframe", "id", "id * 1.0 as high_price", "id - 1.0 as low_price", "id as v")
        marks = rows.selectExpr("symbol", "id as t")
        began = time.perf_counter()
        for df in (structure.fractal_neighbours(rows), decision.nearest(marks, rows.selectExpr("symbol", "id * 3 as u", "v").where("v % 1000 = 0"), ["symbol"], "t", "u", "v")):
            df.write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    seconds(1000)
    assert seconds(120_000) < 6 * max(seconds(30_000), 0.5)
