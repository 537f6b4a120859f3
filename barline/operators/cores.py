"""The order-dependent folds, as plain Python over the rows of one series; no Spark here.

Rows are numbered from 1. Directions and fractals are coded 1, -1 and 0.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass, field, replace

FORMING, PENDING, CONFIRMED = 0, 1, 2


# --- inclusion merge ---------------------------------------------------------------------------------


class CbarStack:
    """Merged bars of a series so far: [start, end, high, low], in order; push() adds a bar."""

    def __init__(self, rows: list | None = None):
        self.rows: list[list] = rows or []

    def push(self, number: int, high: float, low: float) -> int:
        """Adds a bar and returns how many merged bars stay as they were."""
        start, rows = number, self.rows
        while rows and ((rows[-1][2] >= high and rows[-1][3] <= low) or (rows[-1][2] <= high and rows[-1][3] >= low)):
            start, _, h, l = rows.pop()
            high, low = max(high, h), min(low, l)
        rows.append([start, number, high, low])
        return len(rows) - 1


def cbars(highs, lows) -> list[list]:
    """All merged bars of a series."""
    stack = CbarStack()
    for i, (h, l) in enumerate(zip(highs, lows), 1):
        stack.push(i, h, l)
    return stack.rows


def fractals(bars: list[list]) -> list[int]:
    """Code of each merged bar by its neighbours; the first and last have 0."""
    out = [0] * len(bars)
    for i in range(1, len(bars) - 1):
        (lh, ll), (h, l), (rh, rl) = (bars[k][2:4] for k in (i - 1, i, i + 1))
        if h >= max(lh, rh) and l >= max(ll, rl):
            out[i] = 1
        elif h <= min(lh, rh) and l <= min(ll, rl):
            out[i] = -1
    return out


# --- swings ------------------------------------------------------------------------------------------


@dataclass
class Swing:
    direction: int
    start: int  # number of a merged bar
    end: int
    sbar_start: int
    sbar_end: int
    high: float
    low: float
    state: int = FORMING
    number: int = 0
    span: int = 1
    volume: float = 0.0
    start_oi: float = 0.0
    end_oi: float = 0.0
    seen: tuple | None = field(default=None, repr=False, compare=False)  # start, end, high, low of the bars fitted so far


class _Path:
    """Merged bars with fractals and envelopes, by number."""

    def __init__(self, bars: list[list]):
        self.bars, self.kinds = bars, fractals(bars)

    def kind(self, number: int) -> int:
        return self.kinds[number - 1] if 1 <= number <= len(self.kinds) else 0

    def envelope(self, number: int) -> tuple[float, float]:
        """Highest and lowest price of a bar and its neighbours."""
        near = self.bars[max(0, number - 2) : number + 1]
        return max(b[2] for b in near), min(b[3] for b in near)

    def apart(self, a: int, b: int) -> bool:
        """Whether the envelopes don't even touch."""
        (ha, la), (hb, lb) = self.envelope(a), self.envelope(b)
        return max(la, lb) > min(ha, hb)

    def extreme(self, a: int, b: int, direction: int) -> int:
        """The highest (up) or lowest bar from a to b; of equals the last."""
        best = a
        for n in range(a, b + 1):
            if (self.bars[n - 1][2] - self.bars[best - 1][2] if direction == 1 else self.bars[best - 1][3] - self.bars[n - 1][3]) >= -2.3e-16:
                best = n
        return best

    def fit(self, s: Swing) -> Swing:
        """Price and bar ranges of all bars that the swing spans; only what is new since the last time is read."""
        start, end, high, low = s.seen or (0, 0, 0.0, 0.0)
        if start != s.start or end > s.end:
            start, end, high, low = s.start, s.start, *self.bars[s.start - 1][2:4]
        for b in self.bars[end : s.end]:
            high, low = max(high, b[2]), min(low, b[3])
        s.seen = start, s.end, high, low
        s.high, s.low = high, low
        s.sbar_start, s.sbar_end = self.bars[s.start - 1][0], self.bars[s.end - 1][1]
        return s


def swings(bars: list[list], semantics: str = "spec") -> list[Swing]:
    """Swings between fractals.

    "spec": a reverse swing is opened where the end fractal's envelope is apart from the start's, or where it has at
    least 0.6 of the amplitude of the swing before and five bars between; the swing before is confirmed then, and a
    further extreme of the pending kind takes the reverse swing back. "as_coded": the bootstrap check, that the end
    must break a fractal older than the first, never holds, so the one swing is only ever extended, and the tail is
    confirmed.
    """
    path, rows = _Path(bars), []
    step = {"spec": _spec_step, "as_coded": _coded_step}[semantics]
    for n in range(2, len(bars)):
        if path.kind(n):
            step(path, rows, n)
    if semantics == "as_coded" and rows and rows[-1].state == FORMING:
        rows[-1].state = CONFIRMED
    for i, s in enumerate(rows, 1):
        s.number = i
    return rows


def _open(path: _Path, direction: int, start: int, end: int) -> Swing:
    return path.fit(Swing(direction, start, end, 0, 0, 0.0, 0.0))


def _spec_step(path: _Path, rows: list[Swing], n: int) -> None:
    kind = path.kind(n)
    if not rows:
        rows.append(_open(path, -kind, n, n + 1))
        return
    active, before = rows[-1], rows[-2] if len(rows) > 1 else None
    if before is not None and before.state == PENDING and kind == before.direction:
        further = path.bars[n - 1][2] > path.bars[before.end - 1][2] if kind == 1 else path.bars[n - 1][3] < path.bars[before.end - 1][3]
        if further:
            before.end = n
            path.fit(before)
            rows[-1] = _open(path, -before.direction, n, n + 1)
            return
    if kind != active.direction:
        more = path.bars[n - 1][2] >= path.bars[active.start - 1][2] if kind == 1 else path.bars[n - 1][3] <= path.bars[active.start - 1][3]
        if before is None and more:
            active.start = n
        active.end = n + 1
        path.fit(active)
        return
    accept = path.apart(active.start, n)
    if not accept and before is not None:
        (ha, la), (hb, lb) = path.envelope(active.start), path.envelope(n)
        size = before.high - before.low
        accept = size > 2.3e-16 and (max(ha, hb) - min(la, lb)) / size >= 0.6 and n - active.start - 1 >= 5
    if not accept:
        active.end = n + 1
        path.fit(active)
        return
    active.end = path.extreme(active.start, n, active.direction)
    path.fit(active).state = PENDING
    if before is not None and before.state == PENDING:
        before.state = CONFIRMED
    rows.append(_open(path, -active.direction, active.end, n + 1))


def _coded_step(path: _Path, rows: list[Swing], n: int) -> None:
    kind = path.kind(n)
    if not rows:
        rows.append(_open(path, -kind, n, n + 1))
        return
    active = rows[-1]
    blocked = kind != active.direction or any(path.kind(x) and not path.apart(x, n) for x in (active.start, active.end))
    if blocked:
        high, low = path.envelope(n)
        active.high, active.low = max(active.high, high), min(active.low, low)
        active.end, active.sbar_end = n, path.bars[n - 1][1]
        return
    active.end = n + 1
    path.fit(active)


# --- trends ------------------------------------------------------------------------------------------


@dataclass
class Trend:
    direction: int
    start: int  # number of a swing
    end: int
    sbar_start: int
    sbar_end: int
    high: float
    low: float
    span: int
    volume: float
    start_oi: float
    end_oi: float
    completed: bool = False
    number: int = 0


class _Sequence:
    """A trend in the making with its counter swings, merged where one contains the next."""

    def __init__(self, trend: Trend | None = None):
        self.trend, self.ranges = trend, []

    def take(self, s: Swing) -> None:
        """Keeps the range of a counter swing."""
        if self.trend is None or s.direction == self.trend.direction:
            return
        high, low = s.high, s.low
        pick = max if self.trend.direction == 1 else min
        while self.ranges and ((self.ranges[-1][0] >= high and self.ranges[-1][1] <= low) or (self.ranges[-1][0] <= high and self.ranges[-1][1] >= low)):
            h, l = self.ranges.pop()
            high, low = (max(high, h), pick(low, l)) if self.trend.direction == 1 else (pick(high, h), min(low, l))
        self.ranges.append((high, low))

    def extend(self, s: Swing) -> None:
        if self.trend is None:
            self.trend = Trend(s.direction, s.number, s.number, s.sbar_start, s.sbar_end, s.high, s.low, s.span, s.volume, s.start_oi, s.end_oi)
        t = self.trend
        t.end, t.sbar_end, t.end_oi = s.number, s.sbar_end, s.end_oi
        t.high, t.low = max(t.high, s.high), min(t.low, s.low)
        t.span += s.span
        t.volume += s.volume

    def turn(self) -> int:
        """Fractal code of the last three ranges."""
        if len(self.ranges) < 3:
            return 0
        (lh, ll), (h, l), (rh, rl) = self.ranges[-3:]
        if h >= max(lh, rh) and l >= max(ll, rl):
            return 1
        return -1 if h <= min(lh, rh) and l <= min(ll, rl) else 0

    def gap(self) -> bool:
        kind = self.turn()
        if not kind:
            return False
        (lh, ll), (h, l), (rh, rl) = self.ranges[-3:]
        return lh < l < rh if kind == 1 else ll > h > rl


class _Trends:
    def __init__(self, done: list[Swing]):
        self.swings, self.numbers = done, [s.number for s in done]
        self.rows: list[Trend] = []
        self.active, self.pullback = _Sequence(), _Sequence()

    # lookups

    def between(self, a: int, b: int) -> list[Swing]:
        return self.swings[bisect_left(self.numbers, a) : bisect_right(self.numbers, b)]

    def limit(self, a: int, b: int, direction: int, highest: bool) -> Swing | None:
        """The swing of a direction with the highest high (of equals the last) or lowest low (of equals the first)."""
        own = [s for s in self.between(a, b) if s.direction == direction]
        if not own:
            return None
        return max(reversed(own), key=lambda s: s.high) if highest else min(own, key=lambda s: s.low)

    def beside(self, number: int, by: int) -> Swing | None:
        i = bisect_left(self.numbers, number)
        known = i < len(self.numbers) and self.numbers[i] == number
        return self.swings[i + by] if known and 0 <= i + by < len(self.swings) else None

    # building

    def show(self, t: Trend | None) -> None:
        """The last row becomes t."""
        if t is not None:
            self.rows[-1:] = [replace(t)]

    def confirm(self, t: Trend) -> Trend:
        t = replace(t, completed=True)
        first = self.limit(t.start, t.end, t.direction, t.direction == -1)
        if first is not None and first.number != t.start:
            t.start, t.sbar_start = first.number, first.sbar_start
            t.high, t.low = max(t.high, first.high), min(t.low, first.low)
            older = self.rows[-2] if len(self.rows) > 1 else None
            end = self.beside(t.start, -1)
            if older is not None and older.completed and end is not None and older.end != end.number:
                older.end, older.sbar_end = end.number, end.sbar_end
                older.high, older.low = max(older.high, end.high), min(older.low, end.low)
        last = self.limit(t.start, t.end, t.direction, t.direction == 1)
        if last is not None:
            t.end, t.sbar_end, t.end_oi = last.number, last.sbar_end, last.end_oi
            t.high, t.low = max(t.high, last.high), min(t.low, last.low)
        own = self.between(t.start, t.end)
        if own:
            t.span, t.volume = sum(s.span for s in own), sum(s.volume for s in own)
            t.start_oi, t.end_oi = own[0].start_oi, own[-1].end_oi
        return t

    def split(self, base: _Sequence) -> _Sequence:
        """The pullback inside a trend whose counter swings left a gap."""
        out, t = _Sequence(), base.trend
        if t is None or not base.gap():
            return out
        top = self.limit(t.start, t.end, -t.direction, t.direction == 1)
        own = self.between(top.number, t.end) if top is not None else []
        if not own:
            return out
        out.trend = Trend(-t.direction, top.number, t.end, top.sbar_start, t.sbar_end, top.high, top.low, 0, 0.0, top.start_oi, t.end_oi)
        for s in own:
            out.take(s)
            out.extend(s)
        return out

    def begin(self, after: int, direction: int, s: Swing) -> None:
        """A new trend from the swing after a number up to s; without such a swing nothing is active."""
        first = self.beside(after, 1)
        self.active, self.pullback = _Sequence(), _Sequence()
        if first is None:
            return
        t = Trend(direction, first.number, s.number, first.sbar_start, s.sbar_end, max(first.high, s.high), min(first.low, s.low), first.span + s.span, first.volume + s.volume, first.start_oi, s.end_oi)
        t.number = self.next_number()
        self.rows.append(replace(t))
        self.active = _Sequence(t)
        for x in self.between(t.start, t.end):
            self.active.take(x)

    def next_number(self) -> int:
        self.issued = getattr(self, "issued", 0) + 1
        return self.issued

    def seed(self) -> int | None:
        for i in range(2, len(self.swings)):
            a, b, c = self.swings[i - 2 : i + 1]
            meet = max(a.low, b.low, c.low) <= min(a.high, b.high, c.high)
            turns = a.direction and a.direction == -b.direction == c.direction
            onward = a.direction * (c.high - a.high) > 0 and a.direction * (c.low - a.low) > 0
            if meet and turns and onward:
                t = Trend(a.direction, a.number, c.number, a.sbar_start, c.sbar_end, max(a.high, c.high), min(a.low, c.low), a.span + b.span + c.span, a.volume + b.volume + c.volume, a.start_oi, c.end_oi)
                t.number = self.next_number()
                self.rows.append(replace(t))
                self.active = _Sequence(t)
                self.active.take(b)
                return i
        return None

    def step(self, s: Swing) -> None:
        if self.pullback.trend is not None:
            self.pull(s)
            return
        self.active.extend(s)
        self.active.take(s)
        self.show_or_add(self.active.trend)
        if not self.active.turn():
            return
        if self.active.gap():
            self.pullback = self.split(self.active)
            return
        t = self.active.trend
        done = self.confirm(t)
        self.show(done)
        self.begin(done.end, -t.direction, s)

    def show_or_add(self, t: Trend) -> None:
        if self.rows:
            self.show(t)
        else:
            self.rows.append(replace(t))

    def both(self, s: Swing) -> None:
        self.active.extend(s)
        self.active.take(s)
        self.show(self.active.trend)

    def pull(self, s: Swing) -> None:
        t = self.active.trend
        if t is None:
            return
        if s.high > t.high if t.direction == 1 else s.low < t.low if t.direction == -1 else False:
            self.both(s)
            self.pullback = _Sequence()
            return
        self.pullback.extend(s)
        self.pullback.take(s)
        turn = self.pullback.turn()
        if not turn:
            self.both(s)
            return
        if turn != self.pullback.trend.direction:
            self.both(s)
            self.pullback.take(s)
            self.pullback.extend(s)
            return
        t.completed = True
        self.show(self.confirm(t))
        if self.pullback.gap():
            self.active = self.pullback
            self.show(self.active.trend)
            self.pullback = self.split(self.active)
            return
        done = self.confirm(self.pullback.trend)
        self.show(done)
        self.begin(done.end, -t.direction, s)


def trends(rows: list[Swing]) -> list[Trend]:
    """Trends of the confirmed swings; fewer than three give none."""
    done = [s for s in rows if s.state == CONFIRMED]
    out = _Trends(done)
    i = out.seed() if len(done) >= 3 else None
    for s in done[i + 1 :] if i is not None else ():
        out.step(s)
    return out.rows


# --- recursions --------------------------------------------------------------------------------------


class Ema:
    """Exponential average with weight 2 / (n + 1), from the first value."""

    def __init__(self, n: int):
        self.weight, self.value = 2.0 / (n + 1), None

    def __call__(self, price: float) -> float:
        self.value = price if self.value is None else self.value + self.weight * (price - self.value)
        return self.value


class Atr:
    """Wilder's average of true ranges over n bars, from the first one."""

    def __init__(self, n: int):
        self.n, self.value, self.before = n, None, None

    def __call__(self, high: float, low: float, close: float) -> float:
        reach = high - low if self.before is None else max(high - low, abs(high - self.before), abs(low - self.before))
        self.before = close
        self.value = reach if self.value is None else (self.value * (self.n - 1) + reach) / self.n
        return self.value


def first_change(before: list, now: list, growth_counts: bool) -> int | None:
    """Number of the first row that differs; where one list ends, its next number if rows went or growth counts."""
    for i, (a, b) in enumerate(zip(before, now), 1):
        if a != b:
            return i
    if len(before) > len(now) or (len(now) > len(before) and growth_counts):
        return min(len(before), len(now)) + 1
    return None
