"""Lifecycle of a live adapter: connect with backoff, heartbeats, replay of subscriptions, counters."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Protocol


class Adapter(Protocol):
    def connect(self) -> None: ...
    def heartbeat(self) -> None: ...
    def subscribe(self, channel: str) -> None: ...
    def poll(self) -> dict | None: ...


@dataclass
class Stats:
    reconnect_total: int = 0
    connect_failures: int = 0
    heartbeat_failures: int = 0
    subscription_replays: int = 0


@dataclass
class Resilient:
    """An adapter that reconnects. Times are seconds of `clock`."""

    adapter: Adapter
    initial: float = 0.5
    most: float = 30.0
    heartbeat_every: float = 5.0
    clock: Callable[[], float] = time.monotonic
    sleep: Callable[[float], None] = time.sleep
    stats: Stats = field(default_factory=Stats)
    channels: list[str] = field(default_factory=list)
    connected: bool = False
    attempts: int = 0
    beat: float = 0.0
    ever: bool = False

    def backoff(self, attempt: int) -> float:
        return min(self.initial * 2 ** min(max(attempt - 1, 0), 10), max(self.most, self.initial))

    def subscribe(self, channel: str) -> None:
        """Remembers a channel, once; a connected adapter gets it now, another when it connects."""
        if channel not in self.channels:
            self.channels.append(channel)
            if self.connected:
                self.adapter.subscribe(channel)

    def ensure(self) -> bool:
        """Connects if needed; False, after the backoff's pause, if that failed."""
        if self.connected:
            return True
        try:
            self.adapter.connect()
        except Exception:
            self.stats.connect_failures += 1
            self.attempts += 1
            self.sleep(self.backoff(self.attempts))
            return False
        self.stats.reconnect_total += self.ever
        self.connected, self.ever, self.attempts, self.beat = True, True, 0, self.clock()
        for channel in self.channels:
            self.adapter.subscribe(channel)
            self.stats.subscription_replays += 1
        return True

    def poll(self) -> dict | None:
        if not self.ensure():
            return None
        if self.clock() - self.beat >= self.heartbeat_every:
            try:
                self.adapter.heartbeat()
                self.beat = self.clock()
            except Exception:
                self.stats.heartbeat_failures += 1
                self.connected = False
                return None
        try:
            return self.adapter.poll()
        except Exception:
            self.connected = False
            return None


def pump(source: Resilient, count: int, publish: Callable[[dict], None]) -> int:
    """Publishes up to count items, with 100 polls an item at most; how many there were."""
    done = 0
    for _ in range(100 * count):
        if done == count:
            break
        if (item := source.poll()) is not None:
            publish(item)
            done += 1
    return done


def register_trade_source(spark, messages: Callable[[], Iterable[str]], name: str = "trades") -> None:
    """A streaming source of trade messages: a batch for each micro-batch from `messages`, one JSON text a row.

    The client is the caller's (a WebSocket one on a live system); the reader keeps what it handed out until the batch
    is committed, so that a failed batch is read again.
    """
    from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

    class Reader(SimpleDataSourceStreamReader):
        def __init__(self):
            self.kept: dict[int, list] = {}

        def initialOffset(self) -> dict:
            return {"batch": 0}

        def read(self, start: dict):
            own = [(m,) for m in messages()]
            self.kept[start["batch"]] = own
            return iter(own), {"batch": start["batch"] + 1}

        def readBetweenOffsets(self, start: dict, end: dict):
            return iter([r for b in range(start["batch"], end["batch"]) for r in self.kept.get(b, [])])

        def commit(self, end: dict) -> None:
            self.kept = {b: r for b, r in self.kept.items() if b >= end["batch"]}

    class Trades(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return "value string"

        def simpleStreamReader(self, schema):
            return Reader()

    spark.dataSource.register(Trades)
