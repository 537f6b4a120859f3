import random

import pytest

from barline.operators import cores
from barline.operators.cores import CONFIRMED, PENDING, Swing


def walk(seed, n=400):
    rng, price, highs, lows = random.Random(seed), 100.0, [], []
    for _ in range(n):
        price += rng.uniform(-2, 2)
        highs.append(price + rng.random())
        lows.append(price - rng.random())
    return highs, lows


@pytest.mark.parametrize("n, expected", [(1, [1, 1, 10, 1]), (2, [1, 2, 10, 1]), (3, [1, 3, 12, 0])])
def test_merge_chain(n, expected):
    assert cores.cbars([10, 9, 12][:n], [1, 2, 0][:n]) == [expected]


@pytest.mark.parametrize("seed", range(20))
def test_merged_bars_tile_and_never_contain_each_other(seed):
    highs, lows = walk(seed)
    rows = cores.cbars(highs, lows)
    assert [r[0] for r in rows] == [1, *(r[1] + 1 for r in rows[:-1])] and rows[-1][1] == len(highs)
    for s, e, h, l in rows:
        own = list(zip(highs[s - 1 : e], lows[s - 1 : e]))
        assert (h, l) == (max(x[0] for x in own), min(x[1] for x in own)) and (h, l) in own
    assert not any((a[2] >= b[2] and a[3] <= b[3]) or (a[2] <= b[2] and a[3] >= b[3]) for a, b in zip(rows, rows[1:]))


@pytest.mark.parametrize("seed", range(20))
def test_confirmed_swings_alternate_and_join(seed):
    rows = cores.cbars(*walk(seed))
    kinds, done = cores.fractals(rows), [s for s in cores.swings(rows) if s.state == CONFIRMED]
    assert len(done) >= 2
    for a, b in zip(done, done[1:]):
        assert a.end == b.start and a.direction == -b.direction
    assert all((kinds[s.start - 1], kinds[s.end - 1]) == (-s.direction, s.direction) for s in done)
    states = [s.state for s in cores.swings(rows)]
    assert PENDING not in states[:-2]


@pytest.mark.parametrize("seed", range(5))
def test_as_coded_never_opens_a_second_swing(seed):
    rows = cores.cbars(*walk(seed))
    found = cores.swings(rows, "as_coded")
    assert len(found) == 1 and found[0].state == CONFIRMED and cores.trends(found) == []


GOLDEN = [(1, 10, 5), (-1, 9, 4), (1, 11, 6), (-1, 11, 9), (1, 12, 10), (-1, 10, 8), (1, 13, 11), (-1, 12, 7)]


def golden(n):
    return [Swing(d, 0, 0, i, i, h, l, CONFIRMED, i, 1, 1.0, 1.0, 1.0) for i, (d, h, l) in enumerate(GOLDEN[:n], 1)]


def test_trend_switch():
    def shown(n):
        return [(t.direction, t.start, t.end, t.high, t.low, t.span, t.volume, t.completed) for t in cores.trends(golden(n))]

    assert shown(2) == [] and shown(3) == [(1, 1, 3, 11, 5, 3, 3.0, False)]
    assert shown(7) == [(1, 1, 5, 12, 5, 5, 5.0, True), (-1, 6, 7, 13, 8, 3, 3.0, False)]
    assert shown(8) == [(1, 1, 5, 12, 5, 5, 5.0, True), (-1, 6, 8, 13, 7, 4, 4.0, False)]
    assert cores.first_change(cores.trends(golden(7)), cores.trends(golden(8)), True) == 2


@pytest.mark.parametrize("seed", range(40))
def test_completed_trends_hold_a_swing_of_their_direction(seed):
    rng, rows, price = random.Random(seed), [], 100.0
    for i in range(1, 120):
        d, size = (1 if i % 2 else -1), rng.uniform(1, 10)
        a, b = price, price + d * size
        rows.append(Swing(d, i, i + 1, i, i, max(a, b), min(a, b), CONFIRMED, i, 1, 1.0, 1.0, 1.0))
        price = b
    found = cores.trends(rows)
    assert len(found) > 1
    for t in found:
        if t.completed:
            own = [s for s in rows if t.start <= s.number <= t.end]
            assert t.end >= t.start and any(s.direction == t.direction for s in own)


def test_averages():
    ema, atr = cores.Ema(3), cores.Atr(2)
    assert [ema(x) for x in (1.0, 2.0, 3.0)] == [1.0, 1.5, 2.25]
    assert [atr(*x) for x in ((3, 1, 2), (5, 4, 5), (4, 1, 2))] == [2, 2.5, 3.25]


def test_first_change():
    assert cores.first_change([1, 2], [1, 2], True) is None
    assert cores.first_change([1, 2], [1, 3], False) == 2
    assert cores.first_change([1, 2], [1], False) == 2
    assert (cores.first_change([1], [1, 2], True), cores.first_change([1], [1, 2], False)) == (2, None)
