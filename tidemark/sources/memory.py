"""Bounded sources: rows in memory, generated rows, random and configuration streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition


def vec_source(spark: SparkSession, rows: Sequence[tuple], schema: T.StructType | str, parallelism: int = 1) -> DataFrame:
    """Rows dealt over ``parallelism`` partitions. An empty list needs the schema only."""
    df = spark.createDataFrame(list(rows), schema)
    return df.repartition(parallelism) if parallelism > 1 else df.coalesce(1)


class Split(InputPartition):
    """One task's part of a source: its number, how many there are, and its properties."""

    def __init__(self, number: int, of: int, properties: dict[str, str]):
        super().__init__(number)
        self.number, self.of, self.properties = number, of, properties


class _Reader(DataSourceReader):
    def __init__(self, rows: Callable[[Split], Iterator[tuple]], splits: list[Split]):
        self.rows, self.splits = rows, splits

    def partitions(self) -> list[InputPartition]:
        return self.splits

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from self.rows(partition)


def iterator_source(spark: SparkSession, rows: Callable[[Split], Iterator[tuple]], columns: str, parallelism: int = 1, splits: Sequence[dict[str, str]] | None = None, name: str = "tidemark_iterator") -> DataFrame:
    """Rows from a generator function, one call per split, lazily. ``splits``: each one's properties, if not just numbers; there must be ``parallelism`` of them."""
    props = list(splits) if splits is not None else [{} for _ in range(parallelism)]
    if len(props) != parallelism:
        raise ValueError(f"{len(props)} splits for a parallelism of {parallelism}")
    planned = [Split(i, parallelism, p) for i, p in enumerate(props)]

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return columns

        def reader(self, schema: T.StructType) -> DataSourceReader:
            return _Reader(rows, planned)

    spark.dataSource.register(Source)
    return spark.read.format(name).load()


class _Numbered(DataSourceStreamReader):
    """Numbers from 0 as offsets; each micro-batch takes the next ``per_batch`` of them, dealt over splits."""

    def __init__(self, rows: Callable[[int, int], Iterator[tuple]], per_batch: int, parallelism: int, end: int | None):
        self.rows, self.per_batch, self.parallelism, self.end, self.at = rows, per_batch, parallelism, end, 0

    def initialOffset(self) -> dict:
        return {"n": 0}

    def latestOffset(self) -> dict:
        self.at = self.at + self.per_batch if self.end is None else min(self.at + self.per_batch, self.end)
        return {"n": self.at}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        self.at = max(self.at, end["n"])  # after a restart the log says how far it was
        lo, n = start["n"], end["n"] - start["n"]
        edges = [lo + n * i // self.parallelism for i in range(self.parallelism + 1)]
        return [InputPartition((a, b)) for a, b in zip(edges, edges[1:]) if a < b]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from self.rows(*partition.value)


def generator_stream(spark: SparkSession, rows: Callable[[int, int], Iterator[tuple]], columns: str, per_batch: int = 1000, parallelism: int = 1, end: int | None = None, name: str = "tidemark_generator") -> DataFrame:
    """A stream of generated rows: ``rows(first, beyond)`` gives those of the numbers first to beyond - 1, always the same, so that
    a repeated micro-batch is the same. ``end`` bounds the numbers. Runs in the executors; the prologue and epilogue of the generator
    are its open and close."""

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return columns

        def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
            return _Numbered(rows, per_batch, parallelism, end)

    spark.dataSource.register(Source)
    return spark.readStream.format(name).load()


def random_stream(spark: SparkSession, rows_per_second: int = 100) -> DataFrame:
    """An endless stream of (timestamp, name, value): now, "name-v" and v even in 0 to 99."""
    v = F.floor(F.rand() * 100).cast("bigint")
    rate = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
    return rate.select(F.unix_millis("timestamp").alias("timestamp"), v.alias("value")).select("timestamp", F.concat(F.lit("name-"), F.col("value")).alias("name"), "value")


def random_rows(spark: SparkSession, n: int, start: int = 0, seed: int = 7) -> DataFrame:
    """``n`` bounded rows of the same kind: one each 10 ms from ``start``, the values drawn by a seed."""
    rows = spark.range(n).select((F.lit(start) + F.col("id") * 10).alias("timestamp"), F.floor(F.rand(seed) * 100).cast("bigint").alias("value"))
    return rows.select("timestamp", F.concat(F.lit("name-"), F.col("value")).alias("name"), "value")


def config_stream(spark: SparkSession, name: str, n: int = 5) -> DataFrame:
    """The configuration rows one a second, as a side stream that ends after ``n``: unlike a main input it keeps no query waiting."""
    rate = spark.readStream.format("rate").option("rowsPerSecond", 1).load().where(F.col("value") < n)
    return rate.select(F.concat(F.lit(f"{name}-"), F.col("value")).alias("field"), F.col("value").cast("string").alias("value"))


def stop_with(main: Any, *side: Any) -> None:
    """Wait for the main query; then stop those of daemon inputs, which never end by themselves."""
    try:
        main.awaitTermination()
    finally:
        for q in side:
            q.stop()


def config_source(spark: SparkSession, name: str, n: int = 5) -> DataFrame:
    """A side input of ``n`` configuration rows (field, value): ("name-i", "i"). A static table: it doesn't keep a query alive."""
    return spark.range(n).select(F.concat(F.lit(f"{name}-"), F.col("id")).alias("field"), F.col("id").cast("string").alias("value"))


def sequence_rows(split: Split, n: int = 0) -> Iterator[tuple[Any, ...]]:
    """Numbers below ``n`` that fall to this split."""
    yield from ((i,) for i in range(split.number, n, split.of))
