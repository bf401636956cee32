"""Keyed stateful processors for what columns can't express on a stream: strict lateness, processes over several inputs, custom folds.

They run under ``transformWithState``, which needs the RocksDB state store: :func:`use_rocksdb`. A processor meets a key's rows of a
micro-batch one by one, so keep the columns of a hot key few, and prefer :mod:`tidemark.streaming.corrections`, which compares in columns.
"""

from __future__ import annotations

import pickle
import time
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.streaming.watermarks import RowWatermark, Strategy, bounded

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _schema(s: T.StructType | str) -> T.StructType:
    return T._parse_datatype_string(s) if isinstance(s, str) else s


def _in_order(rows: Iterable[Row], order: Sequence[str]) -> Iterable[Row]:
    """Rows of one key and micro-batch by ``order``, nulls first; as they come without one."""
    return sorted(rows, key=lambda r: tuple((r[c] is not None, r[c]) for c in order)) if order else rows


# -- strict lateness ---------------------------------------------------------------------------------------------------------------


class _Strict(StatefulProcessor):
    """Per source: its watermark with its generator, kept as state; each micro-batch ends with a tick."""

    def __init__(self, strategy: Strategy, columns: list[str], order: list[str], clock: str | None):
        self.strategy, self.columns, self.order, self.clock = strategy, columns, order, clock

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("watermark", "state binary")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        now = int(time.time() * 1000)
        mark = RowWatermark(self.strategy, now)
        if self.kept.exists():
            mark.restore(pickle.loads(bytes(self.kept.get()[0])))
        for row in _in_order(rows, self.order):
            now = row[self.clock] if self.clock else now
            before = mark.watermark
            kept = mark.row(row[self.strategy.column], now)
            yield Row(**{c: row[c] for c in self.columns}, watermark=before, late=not kept)
        mark.tick(now)
        self.kept.update((pickle.dumps(mark.snapshot()),))

    def close(self) -> None:
        pass


def strict(df: DataFrame, strategy: Strategy, source: Sequence[str], order: Sequence[str] = (), clock: str | None = None, tick: str | None = None) -> DataFrame:
    """Each timed row with ``watermark``, what held before it at its source, and ``late``: its time is below that.

    The rules are those of the strategy's generator, row by row in ``order``, with a tick after each micro-batch. Bounded rows get a tick
    where the column ``tick`` (a batch number that leads ``order``) changes. ``clock`` is a column of wall-clock ms; without it, a
    micro-batch is taken at one moment. Rules of this kind are sequential, so a source is one task at a time: its rows are sorted
    and streamed through it, never held. Rows without a time are dropped. Extra columns pass; ``watermark`` and ``late`` must be free.
    """
    if not source:
        raise ValueError("name the columns that tell the sources apart")
    timed = strategy.timed(df)
    schema = T.StructType([*timed.schema.fields, T.StructField("watermark", T.LongType()), T.StructField("late", T.BooleanType())])
    if df.isStreaming:
        return timed.groupBy(*source).transformWithState(_Strict(_plain(strategy), timed.columns, list(order), clock), schema, "Append", "None")
    by, column, arrow, plain = list(source), strategy.column, to_arrow_schema(schema), _plain(strategy)

    def run(batches: Iterator[Any]) -> Iterator[Any]:
        import pyarrow as pa

        at, mark, last, now = None, None, None, 0
        for b in batches:
            out = []
            for row in b.to_pylist():
                k = tuple(row[c] for c in by)
                now = row[clock] if clock else 0
                if mark is None or k != at:
                    at, mark, last = k, RowWatermark(plain, now), row[tick] if tick else None
                elif tick and row[tick] != last:
                    mark.tick(now)
                    last = row[tick]
                before = mark.watermark
                kept = mark.row(row[column], now)
                out.append(row | {"watermark": before, "late": not kept})
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    lead = [tick, *order] if tick and tick not in order else list(order)
    return timed.repartition(*by).sortWithinPartitions(*by, *lead).mapInArrow(run, schema)


def _plain(strategy: Strategy) -> Strategy:
    """The strategy without its column expression, which workers can't take and don't need."""
    return Strategy(strategy.delay, strategy.column, strategy.event_time, strategy.periodic, strategy.idle, strategy.custom)


def mark_late_records(df: DataFrame, source: list[str], ts: str, delay: int) -> DataFrame:
    """Each row with ``late``: its time is below its source's watermark, which advances with every micro-batch. Untimed rows are dropped.

    For hot sources use :class:`tidemark.streaming.corrections.MarkedStream`: the same marks by aggregation and join.
    """
    return strict(df, bounded(delay).with_timestamps(ts), source).drop("watermark")


# -- several inputs ----------------------------------------------------------------------------------------------------------------


class CoProcess:
    """A process over several inputs that keeps state per key. Subclass it; what the methods yield are dicts of the output columns.

    ``state`` is a dict of plain values that lasts: what a method leaves in it is there for the next row of the key, also in later micro-batches.
    """

    def open(self) -> None:
        """Called once in each worker before its first row."""

    def left(self, row: Row, state: dict) -> Iterable[dict]:
        """A row of the first input."""
        return ()

    def right(self, number: int, row: Row, state: dict) -> Iterable[dict]:
        """A row of another input, numbered from 0."""
        return ()

    def close(self) -> None:
        """Called once after the last row."""


class _CoProcessor(StatefulProcessor):
    def __init__(self, make: Callable[[], CoProcess], inputs: list[list[str]], out: list[str], order: list[str]):
        self.make, self.inputs, self.out, self.order = make, inputs, out, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("state", "state binary")
        self.process = self.make()
        self.process.open()

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        state = pickle.loads(bytes(self.kept.get()[0])) if self.kept.exists() else {}
        for row in _in_order(rows, self.order):
            i = row["__input"]
            own = Row(*self.inputs[i])(*(row[c] for c in self.inputs[i]))  # the columns of that input only
            for out in (self.process.left(own, state) if i == 0 else self.process.right(i - 1, own, state)) or ():
                yield Row(**{c: out.get(c) for c in self.out})
        self.kept.update((pickle.dumps(state),))

    def close(self) -> None:
        self.process.close()


def co_process(inputs: Sequence[DataFrame], keys: list[str], process: Callable[[], CoProcess], schema: T.StructType | str, order: list[str]) -> DataFrame:
    """The rows that ``process`` makes of several inputs, which all have the columns ``keys`` (and ``order``): streams, or bounded tables.

    Columns of one name must have one type. Null keys are a key. Without ``order`` rows of a micro-batch come in any order.
    """
    tagged = [df.withColumn("__input", F.lit(i)) for i, df in enumerate(inputs)]
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    missing = sorted(set(order) - set(both.columns))
    if missing:
        raise ValueError(f"no such columns to order by: {missing}")
    out = _schema(schema)
    both.sparkSession.streams.active  # noqa: B018 - bounded inputs need the coordinator of state stores, which this sets up
    return both.groupBy(*keys).transformWithState(_CoProcessor(process, [df.columns for df in inputs], out.names, order), out, "Append", "None")


class _Newest(CoProcess):
    """Left rows with the value that the right input showed last."""

    def __init__(self, value: str, columns: list[str]):
        self.value, self.columns = value, columns

    def left(self, row: Row, state: dict) -> Iterable[dict]:
        yield {c: row[c] for c in self.columns} | {self.value: state.get("value")}

    def right(self, number: int, row: Row, state: dict) -> Iterable[dict]:
        state["value"] = row[self.value]
        return ()


def enrich_evolving(left: DataFrame, config: DataFrame, key: str, value: str, order: str | None = None) -> DataFrame:
    """Left rows with ``value`` of the newest configuration row of their key as text, null before the first: both sides are streams.

    Within a micro-batch configuration comes before left rows, and of several settings of a key the one with the largest ``order`` (a
    column of the configuration), then the largest value, is the newest. A null setting takes the earlier one back.
    """
    text, columns = F.col(value).cast("string"), left.columns
    at = F.col(order) if order else F.lit(None).cast("string")
    side = config.select(key, text.alias(value), F.lit(0).alias("__side"), at.alias("__at"), text.alias("__text"))
    rows = left.withColumn("__side", F.lit(1))
    schema = T.StructType([*left.schema.fields, T.StructField(value, T.StringType())])
    return co_process([rows, side], [key], lambda: _Newest(value, columns), schema, ["__side", "__at", "__text"])


# -- custom folds ------------------------------------------------------------------------------------------------------------------


class _Fold(StatefulProcessor):
    """Per key and window: an accumulator, given out when the watermark passes the window's end."""

    def __init__(self, step: Callable[[dict | None, dict], dict], acc: T.StructType, keys: list[str]):
        self.step, self.acc, self.keys = step, acc, keys

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("acc", self.acc)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        held = dict(zip(self.acc.names, self.value.get())) if self.value.exists() else None
        for row in rows:
            held = self.step(held, row.asDict())
        if held is not None:
            self.value.update(tuple(held[n] for n in self.acc.names))
            self.handle.registerTimer(key[-1])
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        if self.value.exists():
            yield Row(**dict(zip(self.keys, key)), **dict(zip(self.acc.names, self.value.get())))
            self.value.clear()

    def close(self) -> None:
        pass


def fold_windows(assigned: DataFrame, keys: list[str], step: Callable[[dict | None, dict], dict], schema: T.StructType | str) -> DataFrame:
    """A custom fold per key and window of a watermarked stream; ``assigned`` has window_start and window_end in epoch milliseconds."""
    acc = _schema(schema)
    by = [*keys, "window_start", "window_end"]
    out = T.StructType([*(assigned.schema[k] for k in by), *acc.fields])
    return assigned.groupBy(*by).transformWithState(_Fold(step, acc, by), out, "Append", "EventTime")
