"""Keyed state: the circuit breaker as a fold over ordered events, and windowed metrics over a stream."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the breaker, in seconds.
OPEN_AFTER, COOLDOWN, MOST_COOLDOWN = 2, 45.0, 180.0


@dataclass
class Breaker:
    """closed -> open after two failures in a row; half open after the cooldown, which doubles when the probe fails."""

    failures: int = 0
    opened: float | None = None
    cooldown: float = COOLDOWN

    def state(self, now: float) -> str:
        if self.opened is None:
            return "closed"
        return "half_open" if now - self.opened >= self.cooldown else "open"

    def record(self, now: float, ok: bool) -> str:
        """State after an event. An event while the breaker is open was never sent, so it changes nothing."""
        before = self.state(now)
        if before == "open":
            return before
        if ok:
            self.failures, self.opened, self.cooldown = 0, None, COOLDOWN
            return "closed"
        self.failures += 1
        if before == "half_open":
            self.cooldown = min(2 * self.cooldown, MOST_COOLDOWN)
            self.opened = now
        elif self.failures >= OPEN_AFTER:
            self.opened = now
        return self.state(now)


def breaker_states(events: DataFrame) -> DataFrame:
    """key, seq, state after each event of events (key, seq, at: seconds, ok).

    Rows are sorted by (key, at, seq) within partitions and folded one batch after the other, so a hot key needs no more memory."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, b = object(), Breaker()
        for pdf in batches:
            out = []
            for k, at, ok in zip(pdf["key"], pdf["at"], pdf["ok"], strict=True):
                if k != key:
                    key, b = k, Breaker()
                out.append(b.record(at, bool(ok)))
            yield pdf[["key", "seq"]].assign(state=out)

    rows = events.select("key", "seq", F.col("at").cast("double").alias("at"), "ok").repartition("key").sortWithinPartitions("key", "at", "seq")
    return rows.mapInPandas(run, "key long, seq long, state string")


def breaker_stream(events: DataFrame) -> DataFrame:
    """The same fold over a stream of (key, seq, at, ok), its state kept by key between batches."""

    def run(key, batches, state):  # noqa: ANN001, ANN202
        b = Breaker(*state.get) if state.exists else Breaker()
        rows = pd.concat(list(batches)).sort_values(["at", "seq"])
        out = rows[["key", "seq"]].assign(state=[b.record(at, bool(ok)) for at, ok in zip(rows["at"], rows["ok"], strict=True)])
        state.update((b.failures, b.opened, b.cooldown))
        yield out

    return events.groupBy("key").applyInPandasWithState(run, "key long, seq long, state string", "failures int, opened double, cooldown double", "append", "NoTimeout")


def tumbling_metrics(events: DataFrame, seconds: int, late_seconds: int, time: str = "ts", name: str = "event_type", value: str = "value") -> DataFrame:
    """start, name, n, total, last value of each window; works on a table and on a stream (there with a watermark)."""
    rows = events.withColumn(time, F.col(time).cast("timestamp"))
    if events.isStreaming:
        rows = rows.withWatermark(time, f"{late_seconds} seconds")
    g = rows.groupBy(F.window(time, f"{seconds} seconds").alias("w"), F.col(name).alias("name"))
    return g.agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.max(F.struct(time, value))[value].alias("last")).select(F.col("w.start").alias("start"), "name", "n", "total", "last")
