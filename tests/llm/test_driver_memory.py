"""What the driver holds must not grow with the rounds of an iteration."""

from barline.llm.common import cut
from barline.llm.components import components


def bits(df):
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())).bit_length()


def test_estimates_of_size_do_not_grow_over_rounds(spark):
    rows, found = cut(spark.range(30).selectExpr("id AS a")), []
    for _ in range(4):
        rows = cut(rows.join(rows.selectExpr("a", "a + 1 AS b"), "a").selectExpr("b % 30 AS a"))
        found.append(bits(rows))
        assert sorted(r[0] for r in rows.collect()) == list(range(30))
    assert found == found[:1] * 4
    path = spark.range(300).selectExpr("(id * 7919) % 301 AS a", "((id + 1) * 7919) % 301 AS b")
    roots = components(path)
    assert bits(roots) < 1000 and [tuple(r) for r in roots.groupBy("root").count().collect()] == [(0, 301)]
