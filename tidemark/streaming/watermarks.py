"""Watermark strategies: which column is the event time, how far behind the latest one the watermark stays, and who says so.

A plain :class:`Strategy` becomes Spark's own watermark. One with a periodic wrapper, an idle timeout or a generator of its own follows
row-by-row rules that Spark's watermark doesn't have; :func:`tidemark.streaming.state.strict` applies them, on streams and on bounded rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Watermark bounds in epoch milliseconds. MAX stands for the end of the input, IDLE for a source that is left out.
MIN, MAX = 0, 253_402_185_600_000
IDLE = MAX + 1


class WatermarkGenerator:
    """The watermark of one source. Between micro-batches its attributes are kept as state: plain values, or other generators."""

    def on_event(self, ts: int, now: int) -> int | None:
        """Take a row's time (``now`` is the wall clock, in ms); a watermark to publish at once, or None."""
        return None

    def on_tick(self, now: int) -> int | None:
        """A periodic tick: the watermark, IDLE for a source to be left out, None for no news."""
        return None


class BoundedGenerator(WatermarkGenerator):
    """The latest time less ``delay`` + 1, never below 0, on ticks only."""

    def __init__(self, delay: int):
        self.delay, self.latest = delay, MIN

    def on_event(self, ts: int, now: int) -> int | None:
        self.latest = max(self.latest, ts)
        return None

    def on_tick(self, now: int) -> int | None:
        return max(MIN, self.latest - self.delay - 1) if self.latest > self.delay else MIN


class PeriodicGenerator(WatermarkGenerator):
    """Publishes between ticks as well, when event time has moved on by more than ``event`` ms while less than ``process`` ms of
    wall-clock time went by since the last such move: what a fast replay needs."""

    def __init__(self, inner: WatermarkGenerator, process: int, event: int):
        self.inner, self.process, self.event = inner, process, event
        self.anchor: tuple[int, int] | None = None

    def on_event(self, ts: int, now: int) -> int | None:
        said = self.inner.on_event(ts, now)
        if self.anchor is None:
            self.anchor = (ts, now)
        elif ts - self.anchor[0] > self.event:
            if now - self.anchor[1] < self.process:
                said = self.inner.on_tick(now)
            self.anchor = (ts, now)
        return said

    def on_tick(self, now: int) -> int | None:
        return self.inner.on_tick(now)


class IdleGenerator(WatermarkGenerator):
    """IDLE on ticks once no row has come for more than ``timeout`` ms, until the next row."""

    def __init__(self, inner: WatermarkGenerator, timeout: int, now: int = 0):
        self.inner, self.timeout, self.active = inner, timeout, now

    def on_event(self, ts: int, now: int) -> int | None:
        self.active = now
        return self.inner.on_event(ts, now)

    def on_tick(self, now: int) -> int | None:
        return IDLE if now - self.active > self.timeout else self.inner.on_tick(now)


@dataclass(frozen=True)
class Strategy:
    """Built step by step: ``bounded(1000).with_timestamps("timestamp")``.

    ``delay`` bounds the disorder in milliseconds. ``periodic`` (process ms, event ms) lets the watermark advance between ticks during
    fast replays, ``idle`` (ms) leaves quiet sources out, ``custom`` makes the generator of each source. ``assigner`` computes the
    event time, in ms, from the row; ``column`` then names it.
    """

    delay: int
    column: str = "timestamp"
    event_time: str = "event_time"
    periodic: tuple[int, int] | None = None
    idle: int | None = None
    custom: Callable[[], WatermarkGenerator] | None = None
    assigner: Column | None = None

    def wrap_time_periodic(self, process: int, event: int) -> Strategy:
        return replace(self, periodic=(process, event))

    def wrap_idleness(self, timeout: int) -> Strategy:
        return replace(self, idle=timeout)

    def with_timestamps(self, column: str, event_time: str = "event_time") -> Strategy:
        return replace(self, column=column, event_time=event_time)

    def with_assigner(self, ts: Column, column: str = "event_millis") -> Strategy:
        """The event time as any column expression, a UDF included."""
        return replace(self, assigner=ts, column=column)

    @property
    def by_rows(self) -> bool:
        """Whether the watermark follows rules that need :func:`tidemark.streaming.state.strict`."""
        return self.periodic is not None or self.idle is not None or self.custom is not None

    def generator(self, now: int = 0) -> WatermarkGenerator:
        """A new generator for one source, wrapped as asked."""
        out = self.custom() if self.custom else BoundedGenerator(self.delay)
        if self.periodic:
            out = PeriodicGenerator(out, *self.periodic)
        return IdleGenerator(out, self.idle, now) if self.idle is not None else out

    def timed(self, df: DataFrame) -> DataFrame:
        """Rows that have a time, the time as LONG milliseconds."""
        if self.assigner is not None:
            df = df.withColumn(self.column, self.assigner)
        if df.schema[self.column].dataType.typeName() in ("timestamp", "timestamp_ntz"):
            df = df.withColumn(self.column, F.unix_millis(F.col(self.column).cast("timestamp")))
        else:
            df = df.withColumn(self.column, F.col(self.column).cast("bigint"))
        return df.where(F.col(self.column).isNotNull())

    def watermarked(self, timed: DataFrame) -> DataFrame:
        """A stream of timed rows with ``event_time`` and its watermark, which trails by delay + 1 ms, so that a row at exactly latest - delay is not late."""
        return timed.withColumn(self.event_time, F.timestamp_millis(self.column)).withWatermark(self.event_time, f"{self.delay + 1} milliseconds")

    def assign(self, df: DataFrame) -> DataFrame:
        """Timed rows; a stream also gets its watermark. Bounded rows have none, so no row of theirs is late."""
        if df.isStreaming and self.by_rows:
            raise ValueError("periodic, idle and custom watermarks of a stream are applied row by row: name its sources in assign_timestamps")
        timed = self.timed(df)
        return self.watermarked(timed) if df.isStreaming else timed


def bounded(delay: int) -> Strategy:
    """For sources whose rows are at most ``delay`` ms out of order."""
    if delay < 0:
        raise ValueError("delay below 0")
    return Strategy(delay)


def generated(custom: Callable[[], WatermarkGenerator], delay: int = 0) -> Strategy:
    """With a generator of one's own. ``delay`` is what Spark's watermark trails by behind the rows that it lets pass."""
    return replace(bounded(delay), custom=custom)


def _attributes(generator: WatermarkGenerator) -> dict:
    return {k: _attributes(v) if hasattr(v, "on_event") else v for k, v in vars(generator).items()}


def _set_attributes(generator: WatermarkGenerator, kept: dict) -> None:
    for k, v in kept.items():
        inner = getattr(generator, k, None)
        if hasattr(inner, "on_event"):
            _set_attributes(inner, v)
        else:
            setattr(generator, k, v)


class RowWatermark:
    """One source's watermark, advanced row by row and by ticks: the strict rule by which a late record is dropped.

    A row is late if its time is below the watermark that holds before it; a watermark that a late row brings is lost. It never falls.
    """

    def __init__(self, strategy: Strategy, now: int = 0):
        self.generator, self.watermark = strategy.generator(now), MIN

    def snapshot(self) -> dict:
        return {"watermark": self.watermark, "generator": _attributes(self.generator)}

    def restore(self, kept: dict) -> RowWatermark:
        self.watermark = kept["watermark"]
        _set_attributes(self.generator, kept["generator"])
        return self

    def row(self, ts: int, now: int) -> bool:
        """Take a row; whether it is kept."""
        said = self.generator.on_event(ts, now)
        if ts < self.watermark:
            return False
        if said is not None:
            self.watermark = max(self.watermark, said)
        return True

    def tick(self, now: int) -> int:
        """A periodic tick: publish. A source that is idle gives IDLE and holds nothing back until its next row."""
        said = self.generator.on_tick(now)
        if said == IDLE:
            return IDLE
        if said is not None:
            self.watermark = max(self.watermark, said)
        return self.watermark


class Aligner:
    """The low watermark over sources: the smallest one, once every source has reported; sources that tick without one are left out."""

    def __init__(self, sources: list[str]):
        self.marks: dict[str, int | None] = dict.fromkeys(sources)
        self.low: int | None = None

    def report(self, source: str, mark: int) -> int | None:
        self.marks[source] = mark
        return self._align()

    def leave(self, source: str) -> int | None:
        """A source that has ended or never gives watermarks."""
        self.marks.pop(source, None)
        return self._align()

    def _align(self) -> int | None:
        if not self.marks or None in self.marks.values():
            return None
        active = [m for m in self.marks.values() if m != IDLE]
        self.low = min(active) if active else self.low
        return self.low
