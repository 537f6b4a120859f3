from barline.engine import Engine
from barline.operators import structure
from barline.plans import inputs
from tests import gen


def test_engine_runs_from_bars_to_decisions(spark, tmp_path):
    rows = [r for i, tf in enumerate(("m5", "m15", "h1", "d1")) for s in ("A", "B") for r in gen.walk(10 * i + ord(s), 200, s, tf)]
    engine = Engine(spark.createDataFrame(rows, gen.BAR))
    assert engine.count("m5") == 400 and engine.count("d1") == 0
    assert engine.cbars.count() == structure.cbars(engine.bars).count()
    scores = engine.scores.collect()
    assert len(scores) == 1200 and all(-1 <= r["score"] <= 1 for r in scores)
    found = engine.decisions().collect()
    assert {r["symbol"] for r in found} == {"A", "B"} and all(r["action"] in ("buy", "sell", "short", "cover", "wait") for r in found)
    assert engine.events().count() == 6 * 1200
    assert all(r["inclusive_violations"] == r["swing_violations"] == 0 for r in engine.audit().collect())
    engine.write_snapshot(str(tmp_path))
    assert spark.read.parquet(str(tmp_path / "swing")).count() == engine.swings.count()


def test_engine_from_ticks(spark):
    engine = Engine.from_ticks(inputs.ticks(spark, "/root/testdata/sf0.001"), ("m1", "m5", "m15"))
    assert engine.count("m1") > 5 * engine.count("m5") - 25 and engine.count("m15") > 0
