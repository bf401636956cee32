"""Sinks: each returns a function from a DataFrame, bounded or streaming, to the written result or the running query."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterable, Iterator
from typing import Any
from urllib import request as http

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import cut
from tidemark.sources import jdbc
from tidemark.sources.kafka import writer_columns

Sink = Callable[[DataFrame], Any]


#: Seconds without a line after which the header is printed again.
HEADER_AFTER = 3.0


def print_line(df: DataFrame, task: bool = False) -> Column:
    """A row as text: the number of its task if asked for, its window as [HH:mm:ss, HH:mm:ss] if it has one, then the values; null as null,
    binary as text where it is UTF-8, else in hexadecimal."""
    parts: list[Column] = [F.spark_partition_id().cast("string")] if task else []
    if {"window_start", "window_end"} <= set(df.columns):
        t = lambda c: F.date_format(F.timestamp_millis(c), "HH:mm:ss")
        parts.append(F.concat(F.lit("["), t("window_start"), F.lit(", "), t("window_end"), F.lit("]")))
    for f in df.schema.fields:
        if f.name in ("window_start", "window_end"):
            continue
        c = F.col(f"`{f.name}`")
        text = c.cast("string")
        if isinstance(f.dataType, T.BinaryType):
            text = F.when(F.is_valid_utf8(text), text).otherwise(F.concat(F.lit("0x"), F.hex(c)))
        parts.append(F.coalesce(text, F.lit("null")))
    return F.concat_ws(", ", *parts)


def print_sink(rows: int | None = None, checkpoint: str | None = None, task: bool = False, name: str | None = None) -> Sink:
    """Every row as a line, a partition at a time on the driver, under a header that comes again after a pause of ``HEADER_AFTER`` seconds.
    ``rows`` gives a preview instead: so many rows of the table or of each micro-batch."""

    def to(df: DataFrame) -> Any:
        lines = df.select(print_line(df, task).alias(", ".join((["task"] if task else []) + df.columns)))
        if df.isStreaming and rows is None:
            printer = _Printer()
            return _options(lines.writeStream.foreachBatch(lambda batch, _: printer.all(batch)), checkpoint, name).start()
        if df.isStreaming:
            return _options(lines.writeStream.format("console").option("truncate", "false").option("numRows", rows), checkpoint, name).start()
        return _Printer().all(lines) if rows is None else lines.show(rows, truncate=False)

    return to


class _Printer:
    """Prints lines, a partition at a time."""

    def __init__(self) -> None:
        self.last: float | None = None

    def all(self, lines: DataFrame) -> None:
        if self.last is None:
            self.header(lines)
        for line in lines.toLocalIterator():
            if time.monotonic() - self.last > HEADER_AFTER:
                self.header(lines)
            print(line[0])
            self.last = time.monotonic()

    def header(self, lines: DataFrame) -> None:
        print(lines.columns[0])
        self.last = time.monotonic()


def memory_sink(name: str, mode: str = "append", **trigger: Any) -> Sink:
    """A table in the session, for tests."""

    def to(df: DataFrame) -> Any:
        if not df.isStreaming:
            return df.createOrReplaceTempView(name)
        return df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(**(trigger or {"availableNow": True})).start()

    return to


def file_sink(path: str, fmt: str = "parquet", partition_by: Iterable[str] = (), checkpoint: str | None = None, name: str | None = None, **trigger: Any) -> Sink:
    """Files. A stream's files are committed by its log, exactly once."""

    def to(df: DataFrame) -> Any:
        if not df.isStreaming:
            return df.write.format(fmt).partitionBy(*partition_by).save(path)
        if not checkpoint:
            raise ValueError("a stream to files needs a checkpoint folder")
        return _options(df.writeStream.format(fmt).partitionBy(*partition_by).option("path", path).trigger(**(trigger or {"availableNow": True})), checkpoint, name).start()

    return to


def kafka_sink(conf: dict[str, str], topic: str | None = None, checkpoint: str | None = None, name: str | None = None) -> Sink:
    """Messages to Kafka: a fixed topic, or each row's."""

    def to(df: DataFrame) -> Any:
        rows, options = writer_columns(df, topic), {f"kafka.{k}": v for k, v in conf.items()}
        try:
            if not df.isStreaming:
                return rows.write.format("kafka").options(**options).save()
            return _options(rows.writeStream.format("kafka").options(**options), checkpoint, name).start()
        except Exception as e:
            if "DATA_SOURCE_NOT_FOUND" in str(e) or "Failed to find" in str(e):
                raise RuntimeError("the session has no kafka sink: add the package spark-sql-kafka-0-10 of its version") from e
            raise

    return to


def jdbc_sink(urls: list[str], table: str, batch_size: int = 10_000, checkpoint: str | None = None, embedded: bool = False, **options: str) -> Sink:
    """Rows to a JDBC database such as ClickHouse, micro-batch by micro-batch. With several urls a row's content tells which gets it, and
    the rows are computed once, so none is lost or doubled between them. A failed task repeats its batch: let the table replace by key.
    ``embedded`` says that the databases live in the driver's JVM, so that on a cluster the driver writes."""
    if not urls:
        raise ValueError("no url")

    def write(df: DataFrame, _batch: int = 0) -> None:
        if len(urls) == 1:
            parts = [df]
        else:
            dealt = cut(df.withColumn("__shard", F.pmod(F.xxhash64(F.to_json(F.struct("*"))), F.lit(len(urls)))))
            parts = [dealt.where(F.col("__shard") == i).drop("__shard") for i in range(len(urls))]
        for url, part in zip(urls, parts):
            jdbc.append(part, url, table, batch_size, embedded, **options)

    return _per_batch(write, checkpoint)


def bulk_lines(rows: Iterable[dict], index: str, kind: str | None = None, id_column: str | None = None) -> Iterator[str]:
    """The action and document lines of a bulk request."""
    for row in rows:
        action: dict[str, Any] = {"_index": index} | ({"_type": kind} if kind else {})
        if id_column:
            action["_id"] = row[id_column]
        yield json.dumps({"index": action}, ensure_ascii=False)
        yield json.dumps(row, ensure_ascii=False, default=str)


def bulk_sink(address: str, index: str, kind: str | None = None, headers: dict[str, str] | None = None, batch: int = 3000, id_column: str | None = None, checkpoint: str | None = None) -> Sink:
    """Rows to a search index by HTTP bulk requests of at most ``batch`` rows, sent by the executors.

    A refused request or a document with an error fails the task, so it is repeated; give ``id_column`` for that to overwrite.
    """

    def send(rows: Iterator[Any]) -> None:
        def post(held: list[dict]) -> None:
            body = "\n".join(bulk_lines(held, index, kind, id_column)) + "\n"
            request = http.Request(f"{address}/_bulk", body.encode(), {"Content-Type": "application/x-ndjson"} | (headers or {}), method="POST")
            with http.urlopen(request, timeout=60) as answer:
                if json.loads(answer.read() or b"{}").get("errors"):
                    raise RuntimeError("the bulk request has errors")

        held: list[dict] = []
        for row in rows:
            held.append(row.asDict(recursive=True))
            if len(held) >= batch:
                post(held)
                held = []
        if held:
            post(held)

    return _per_batch(lambda df, _batch=0: df.foreachPartition(send), checkpoint)


class OutputFormat:
    """A sink of one's own: subclass it. One instance per task (and micro-batch) runs in the executors; it must be picklable."""

    def open(self, task: int) -> None:
        """Before the first row of a task."""

    def write(self, row: Row) -> None:
        raise NotImplementedError

    def close(self, error: Exception | None) -> None:
        """After the last row, or when one failed."""


def format_sink(make: Callable[[], OutputFormat], checkpoint: str | None = None, name: str | None = None) -> Sink:
    """Rows to an :class:`OutputFormat`, at least once: a task that fails is repeated."""

    def run(rows: Iterator[Row]) -> None:
        task = TaskContext.get()
        out, error = make(), None
        out.open(task.partitionId() if task else 0)
        try:
            for row in rows:
                out.write(row)
        except Exception as e:
            error = e
            raise
        finally:
            out.close(error)

    return _per_batch(lambda df, _batch=0: df.foreachPartition(run), checkpoint, name)


def _per_batch(write: Callable[[DataFrame, int], None], checkpoint: str | None, name: str | None = None) -> Sink:
    def to(df: DataFrame) -> Any:
        return _options(df.writeStream.foreachBatch(write), checkpoint, name).start() if df.isStreaming else write(df, 0)

    return to


def _options(writer: Any, checkpoint: str | None, name: str | None = None) -> Any:
    writer = writer.option("checkpointLocation", checkpoint) if checkpoint else writer
    return writer.queryName(name) if name else writer
