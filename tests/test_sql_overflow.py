"""Hourly ranges of several hundred, for which the SQL's tanh overflows."""

import duckdb

from barline.operators import supply
from barline.plans import catalog
from barline.plans import inputs as I


def test_sd_window50_is_its_sql_where_exp_overflows(spark, tmp_path):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    con.execute("CREATE TABLE events AS SELECT i AS event_id, TIMESTAMP '2024-01-01' + to_minutes(CAST(i * 20 AS BIGINT)) AS ts, i % 7 AS user_id, CASE WHEN i % 2 = 0 THEN 'a' ELSE 'b' END AS event_type, CASE WHEN i % 4 < 2 THEN 1.0 ELSE (i // 40 + 1) * 90.0 END AS value FROM range(600) t(i)")
    con.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    wanted = sorted(con.execute(catalog.oracle_sql()["sd_window50"]).fetchall())
    out = catalog.queries()["sd_window50"](spark, str(tmp_path))
    found = sorted(map(tuple, out.collect()))
    assert [[round(x, 5) if isinstance(x, float) else x for x in r] for r in found] == [[round(float(x), 5) if not isinstance(x, (str, int)) else x for x in r] for r in wanted]
    assert {0.0, 1.0} <= {r["volatility_adjustment"] for r in out.collect()}
    # the operator has the true value
    assert {r[0] for r in supply.score(I.clock(spark, str(tmp_path))).where("id > 60").select("volatility_adjustment").collect()} == {0.0}
