"""Kafka: offset ranges and their properties, reader and writer options, and bounded replay of stored messages."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.properties import Properties
from tidemark.types import KAFKA_MESSAGE

# Property names.
TYPE, BEGIN, END = "type", "begin", "end"
BOOTSTRAP_SERVERS, GROUP_ID, TOPICS, BUFFER_SIZE, OFFSET = "bootstrap.servers", "group.id", "topics", "buffer.size", "offset"


@dataclass(frozen=True)
class OffsetRange:
    """Where reading begins and ends. ``direct``: offsets per topic and partition, both ends inclusive; ``timestamp``: epoch milliseconds per topic; else the latest."""

    kind: str = ""
    begin: dict[str, list[int]] = field(default_factory=dict)
    end: dict[str, list[int]] | None = None

    @staticmethod
    def direct(begin: dict[str, list[int]], end: dict[str, list[int]] | None = None) -> OffsetRange:
        return OffsetRange("direct", begin, end)

    @staticmethod
    def timestamp(begin: dict[str, int], end: dict[str, int] | None = None) -> OffsetRange:
        return OffsetRange("timestamp", {k: [v] for k, v in begin.items()}, None if end is None else {k: [v] for k, v in end.items()})

    def to_properties(self) -> Properties:
        out = Properties()
        if self.kind:
            out.set(TYPE, self.kind)
            for name, side in ((BEGIN, self.begin), (END, self.end or {})):
                for topic, numbers in side.items():
                    out.set(f"{name}.{topic}", ",".join(map(str, numbers)))
        return out

    @staticmethod
    def from_properties(p: Properties) -> OffsetRange:
        kind = p.values.get(TYPE, "")
        if kind not in ("", "direct", "timestamp"):
            raise ValueError(f"unknown offset type {kind!r}")
        begin, end = ({k: [int(x) for x in v.split(",")] for k, v in p.sub(s).values.items()} for s in (BEGIN, END))
        return OffsetRange(kind, begin, end or None) if kind else OffsetRange()

    def reader_options(self, bounded: bool) -> dict[str, str]:
        """Options of Spark's Kafka source. Its ending offsets are exclusive and only for bounded reads."""
        if not self.kind:
            return {} if bounded else {"startingOffsets": "latest"}
        if self.kind == "direct":
            at = lambda side, plus: json.dumps({t: {str(i): o + plus for i, o in enumerate(v)} for t, v in side.items()})
            out = {"startingOffsets": at(self.begin, 0)}
            if bounded and self.end:
                out["endingOffsets"] = at(self.end, 1)
            return out
        if len(self.begin) > 1:
            raise ValueError("begin times of several topics need their partitions: timestamp_options, or a reader per topic as in kafka_source")
        out = {"startingTimestamp": str(next(iter(self.begin.values()))[0])}
        if bounded and self.end:
            out["endingTimestamp"] = str(next(iter(self.end.values()))[0] + 1)
        return out

    def per_topic(self) -> dict[str, OffsetRange]:
        """A range of its own for each topic named."""
        return {t: OffsetRange(self.kind, {t: v}, {t: self.end[t]} if self.end and t in self.end else None) for t, v in self.begin.items()}

    def timestamp_options(self, partitions: dict[str, int], bounded: bool) -> dict[str, str]:
        """The same for several topics, given their numbers of partitions."""
        at = lambda side, plus: json.dumps({t: {str(i): v[0] + plus for i in range(partitions[t])} for t, v in side.items()})
        out = {"startingOffsetsByTimestamp": at(self.begin, 0)}
        if bounded and self.end:
            out["endingOffsetsByTimestamp"] = at(self.end, 1)
        return out

    def holds(self, topic: Column, partition: Column, offset: Column, ts: Column) -> Column:
        """Whether a stored message lies in the range. Topics that the range doesn't name, and null identifiers, don't."""
        if not self.kind:
            return F.lit(True)
        out = F.lit(False)
        for t, begins in self.begin.items():
            if self.kind == "timestamp":
                ok = ts >= begins[0]
                if self.end and t in self.end:
                    ok = ok & (ts <= self.end[t][0])
                out = out | ((topic == t) & ok)
                continue
            for i, b in enumerate(begins):
                ok = offset >= b
                if self.end and t in self.end and i < len(self.end[t]):
                    ok = ok & (offset <= self.end[t][i])
                out = out | ((topic == t) & (partition == i) & ok)
        return F.coalesce(out, F.lit(False))


def _load(reader, fmt: str) -> DataFrame:
    try:
        return reader.load()
    except Exception as e:
        if "Failed to find data source" in str(e) or "DATA_SOURCE_NOT_FOUND" in str(e):
            raise RuntimeError(f"the session has no {fmt} source: add the package spark-sql-kafka-0-10 of its version") from e
        raise


def kafka_source(spark: SparkSession, conf: dict[str, str], topics: Sequence[str], offsets: OffsetRange = OffsetRange(), bounded: bool = False, max_per_trigger: int | None = None, partitions: dict[str, int] | None = None) -> DataFrame:
    """Messages as (timestamp, key, payload, topic, partition, offset). A stream goes on from its checkpoint, else from ``offsets``.

    ``partitions`` gives each topic's number of partitions, if known: begin times of several topics then take one reader.
    """
    parts = [_load((spark.read if bounded else spark.readStream).format("kafka").options(**o), "kafka") for o in source_options(conf, topics, offsets, bounded, max_per_trigger, partitions)]
    return messages(reduce(lambda a, b: a.unionByName(b), parts))


def source_options(conf: dict[str, str], topics: Sequence[str], offsets: OffsetRange, bounded: bool, max_per_trigger: int | None = None, partitions: dict[str, int] | None = None) -> list[dict[str, str]]:
    """The options of each reader that :func:`kafka_source` unites. One reader does, but for begin times of several topics whose numbers
    of partitions aren't given: then each topic has its own."""
    base = {f"kafka.{k}": v for k, v in conf.items()}
    if max_per_trigger and not bounded:
        base["maxOffsetsPerTrigger"] = str(max_per_trigger)
    several = offsets.kind == "timestamp" and len(topics) > 1
    if several and not partitions:
        each = offsets.per_topic()
        absent = sorted(set(topics) - set(each))
        if absent:
            raise ValueError(f"topics without a begin time: {absent}")
        return [base | {"subscribe": t} | each[t].reader_options(bounded) for t in topics]
    at = offsets.timestamp_options(partitions, bounded) if several else offsets.reader_options(bounded)
    return [base | {"subscribe": ",".join(topics)} | at]


def messages(kafka: DataFrame) -> DataFrame:
    return kafka.select(F.unix_millis("timestamp").alias("timestamp"), "key", F.col("value").alias("payload"), "topic", "partition", "offset")


def replay(stored: DataFrame, offsets: OffsetRange) -> DataFrame:
    """The messages of a stored table that lie in the range: filters that reach the scan."""
    return stored.where(offsets.holds(F.col("topic"), F.col("partition"), F.col("offset"), F.col("timestamp")))


def decode(df: DataFrame, schema: T.StructType | str, payload: str = "payload", keep: Sequence[str] = ()) -> DataFrame:
    """JSON payloads as columns; payloads that are null or no JSON objects give null columns."""
    return df.select(*keep, F.from_json(F.col(payload).cast("string"), schema).alias("__j")).select(*keep, "__j.*")


def build_record(timestamp: Column, key: Column, payload: Column, topic: Column, partition: Column, offset: Column) -> list[Column]:
    """The columns of a message, in order and with the types of ``KAFKA_MESSAGE``."""
    given = (timestamp, key, payload, topic, partition, offset)
    return [c.cast(f.dataType).alias(f.name) for c, f in zip(given, KAFKA_MESSAGE.fields)]


def writer_columns(df: DataFrame, topic: str | None = None) -> DataFrame:
    """(key, value, topic) for Spark's Kafka sink from messages; a fixed topic, or each row's own."""
    missing = {"key", "payload", *(() if topic else ("topic",))} - set(df.columns)
    if missing:
        raise ValueError(f"not messages: no {sorted(missing)}")
    return df.select(F.col("key").cast("binary").alias("key"), F.col("payload").cast("binary").alias("value"), (F.lit(topic) if topic else F.col("topic")).alias("topic"))
