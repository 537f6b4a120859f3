import json

import pytest
from pyspark.sql import functions as F

from barline.operators import bars as B
from barline.operators import export, structure
from barline.plans import inputs
from barline.sources import readers, writers
from barline.streaming import live, resilience
from tests import gen


def test_csv_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("datetime,open,close,high_price,low,money\n2024-01-02 09:00:00,1,2,3,0.5,7\n2024-01-01,4,5,6,3,\n")
    rows = readers.csv_bars(spark, str(tmp_path / "a.csv"), "S", "X", "15m").orderBy("datetime").collect()
    assert [(r["open_price"], r["close_price"], r["volume"], r["turnover"], r["timeframe"]) for r in rows] == [(4.0, 5.0, 0.0, 0.0, "m15"), (1.0, 2.0, 0.0, 7.0, "m15")]
    assert readers.csv_bars(spark, str(tmp_path / "a.csv"), "S", "X", "m15", max_rows=1).first()["open_price"] == 4.0
    assert readers.csv_prices(spark, str(tmp_path / "a.csv"), "S", "X", "m15").agg(F.sum("turnover")).first()[0] == 0.0
    (tmp_path / "b.csv").write_text("t,o,c,h,l,v,m,oi\n2024/01/02 09:00:00,1,2,3,0.5,10,20,30\n")
    r = readers.csv_positional(spark, str(tmp_path / "b.csv"), "S", "X", "h1").first()
    assert (r["open_price"], r["close_price"], r["high_price"], r["turnover"], r["open_interest"]) == (1.0, 2.0, 3.0, 20.0, 30.0)


def test_csv_errors(spark, tmp_path):
    (tmp_path / "bad.csv").write_text("datetime,open,high,low,close\nyesterday,1,2,3,4\n")
    with pytest.raises(Exception, match="unreadable datetime"):
        readers.csv_bars(spark, str(tmp_path / "bad.csv"), "S", "X", "m5").collect()
    (tmp_path / "short.csv").write_text("a,b,c,d,e,f,g,h\n2024/01/02 09:00:00,1\n")
    with pytest.raises(Exception):
        readers.csv_positional(spark, str(tmp_path / "short.csv"), "S", "X", "h1").collect()
    with pytest.raises(ValueError, match="no column"):
        readers.normalize_bars(spark.createDataFrame([("1",)], "open string"), "S", "X", "m5")


def test_pipe_log_and_snapshots(spark, tmp_path):
    bars = spark.createDataFrame(gen.cycle("cbar"), gen.BAR)
    for _ in range(2):
        writers.append_pipe_log(bars, str(tmp_path / "log"))
    back = readers.pipe_bars(spark, str(tmp_path / "log"))
    assert back.count() == 240 and back.select("close_price").distinct().count() == bars.select("close_price").distinct().count()
    writers.parquet_snapshot({"sbar": bars, "cbar": structure.cbars(bars)}, str(tmp_path / "snap"))
    assert spark.read.parquet(str(tmp_path / "snap/cbar")).count() == structure.cbars(bars).count()


def test_json_export(spark, tmp_path):
    bars = spark.createDataFrame(gen.walk(5), gen.BAR)
    merged = structure.cbars(bars)
    out = export.payload({"axis": export.cbar_axis(bars, merged), "swings": export.segments(structure.swings(bars), merged, bars)})
    found = json.loads(out.first()["payload"])
    assert len(found["axis"]) == merged.count() and found["axis"][0]["open"] == found["axis"][0]["close"]
    assert {s["state"] for s in found["swings"]} <= {"forming", "pending", "completed"}
    writers.json_payload(out, str(tmp_path / "json"))
    assert spark.read.text(str(tmp_path / "json")).count() == 1


def test_audit_finds_nothing_to_complain_about(spark):
    bars = spark.createDataFrame(gen.walk(5) + gen.walk(6, symbol="RB"), gen.BAR)
    for r in export.audit(bars, structure.cbars(bars), structure.swings(bars), structure.trends(bars)).collect():
        assert (r["inclusive_violations"], r["swing_violations"], r["gap_violations"], r["trend_violations"]) == (0, 0, 0, 0)
        assert r["completed_swings"] >= 2


TRADE = '{"stream":"btcusdt@trade","data":{"e":"trade","E":1700000000000,"s":"BTCUSDT","t":1,"p":"50000.10","q":"0.25","T":1700000000000}}'


def test_trades(spark):
    texts = [TRADE, '{"p":"1","E":5,"s":"A"}', '{"q":"1","T":5,"s":"A"}', '{"p":"2","q":"x","T":5}', "not json", None, '{"p":"1","s":"A"}']
    rows = readers.parse_trades(spark.createDataFrame([(t,) for t in texts], "value string"), first_symbol="FIRST").orderBy(F.desc("close_price")).collect()
    assert [(r["symbol"], r["close_price"], r["volume"], r["turnover"]) for r in rows] == [("BTCUSDT", 50000.10, 0.25, 12500.025), ("FIRST", 2.0, 0.0, 0.0), ("A", 1.0, 0.0, 0.0)]


def test_configuration_files(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"x": {"code": "A", "name": "n", "tick_size": 0.5, "price_precision": 1}, "y": {"code": "A", "name": "m"}}))
    assert [(r["code"], r["name"], r["tick_size"]) for r in readers.symbols(spark, str(tmp_path / "s.json")).collect()] == [("A", "m", None)]
    (tmp_path / "c.yaml").write_text("stable_threshold: 0.6\nf8_weight: 0.4  # more\n")
    config = readers.supply_config(str(tmp_path / "c.yaml"))
    assert (config.stable_threshold, config.f8_weight, config.f1_weight) == (0.6, 0.4, 0.4)
    (tmp_path / "p.yaml").write_text("default:\n  f1_weight: 0.35\nsymbols:\n  I2601:\n    stable_threshold: 0.55\n")
    assert readers.supply_profile(str(tmp_path / "p.yaml")).resolve("i2601", "5m").stable_threshold == 0.55
    with pytest.raises(ValueError):
        readers.symbols(spark, "x.toml")
    assert readers.simple_yaml("a:\n  b: 1\n  c: x\nd: null\n") == {"a": {"b": 1.0, "c": "x"}, "d": None}
    env = readers.environment({"BARLINE_SYMBOLS": " A,,B,A", "BARLINE_MARKET_INGRESS_CAPACITY": "7", "BARLINE_MARKET_OVERLOAD": "DROP_NEWEST"})
    assert (env["symbols"], env["ingress_capacity"], env["overload"], env["channel_capacity"]) == (["A", "B"], 7, "drop_newest", 8192)


def stream_rows(spark, query_of, source, name):
    query = query_of(source).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name)


def test_stream_of_ticks_equals_batch(spark, tmp_path):
    ticks = inputs.ticks(spark, "/root/testdata/sf0.001").select(*[x.split()[0] for x in live.TICK.split(", ")])
    for i in range(3):  # three files in order of time, one for each micro-batch
        rows = ticks.where(f"event_id % 1000 >= {i * 334} and event_id % 1000 < {(i + 1) * 334}")
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(live.TICK).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    found = stream_rows(spark, live.minute_bars, source, "m1_stream").drop("timeframe").collect()
    expected = B.tick_to_m1(ticks, flush=False).drop("timeframe").collect()
    show = lambda rows: sorted((r["symbol"], r["id"], r["datetime"], r["open_price"], r["high_price"], r["low_price"], r["close_price"], round(r["volume"], 6), round(r["turnover"], 4), r["open_interest"]) for r in rows)
    assert show(found) == show(expected)


def test_stream_of_merged_bars_replays_to_the_batch_result(spark, tmp_path):
    bars = gen.walk(7, 160) + gen.walk(8, 160, "RB")
    for i in range(4):
        spark.createDataFrame([b for b in bars if (b[3] - 1) // 40 == i], gen.BAR).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    log = []
    source = spark.readStream.schema(gen.BAR).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    sink = lambda df, n: log.extend((*r, n) for r in df.collect())
    live.to_sinks(live.cbar_changes(source), [sink, lambda df, n: None], str(tmp_path / "check")).awaitTermination(120)
    names = [x.split()[0] for x in live._CBAR_CHANGE.split(", ")]
    changes = spark.createDataFrame(log, live._CBAR_CHANGE + ", batch long")
    assert len({r[-1] for r in log}) == 4
    found = live.replay_changes(changes, "batch").select(*[c for c in names if c != "backtrack_id"])
    df = spark.createDataFrame(bars, gen.BAR)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, structure.cbars(df).collect()))


class Flaky:
    def __init__(self, fail_connects, items):
        self.fails, self.items, self.subscribed, self.beats = fail_connects, items, [], 0

    def connect(self):
        if self.fails:
            self.fails -= 1
            raise OSError
        self.subscribed = []

    def heartbeat(self):
        self.beats += 1
        if self.beats == 2:
            raise OSError

    def subscribe(self, channel):
        self.subscribed.append(channel)

    def poll(self):
        return self.items.pop(0) if self.items else None


def test_reconnect_replays_subscriptions():
    now, pauses, got = [0.0], [], []
    adapter = Flaky(2, [{"n": i} for i in range(6)])
    source = resilience.Resilient(adapter, clock=lambda: now[0], sleep=pauses.append, heartbeat_every=1.5)
    for c in ("a", "b", "a"):
        source.subscribe(c)

    def publish(x):
        got.append(x["n"])
        now[0] += 1

    assert resilience.pump(source, 6, publish) == 6 and got == list(range(6))
    s = source.stats
    assert (s.connect_failures, s.reconnect_total, s.heartbeat_failures, s.subscription_replays) == (2, 1, 1, 4)
    assert pauses == [0.5, 1.0] and adapter.subscribed == ["a", "b"]
    assert source.backoff(99) == 30.0


def test_trade_stream_source(spark):
    resilience.register_trade_source(spark, lambda: [TRADE], "trades_test")
    query = readers.parse_trades(spark.readStream.format("trades_test").load()).writeStream.format("memory").queryName("trades_out").trigger(processingTime="200 milliseconds").start()
    try:
        for _ in range(60):
            query.awaitTermination(0.5)
            if spark.table("trades_out").count():
                break
        assert spark.table("trades_out").first()["symbol"] == "BTCUSDT"
    finally:
        query.stop()


def test_a_wrapped_message_is_its_data_alone(spark):
    rows = spark.createDataFrame([('{"data":{"T":1,"s":"X"},"p":"5"}',), ('{"data":{"T":1,"s":"X","p":"4"},"p":"5"}',), ('{"T":1,"s":"X","p":"5"}',)], "value string")
    assert sorted(r["close_price"] for r in readers.parse_trades(rows).collect()) == [4.0, 5.0]
