"""Running a stream over bounded input to its end."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def closing_time(last: int, delay: int, size: int) -> int:
    """The time of a row that closes all windows of an input whose latest time is ``last``: its watermark passes their ends, and its own
    windows, of at most ``size`` ms (the slide, where that is longer), begin after ``last``."""
    return last + size + delay + 1


def sentinel(spark: SparkSession, schema: T.StructType, ts: str, at: int) -> DataFrame:
    """One row at :func:`closing_time` with nulls elsewhere, to be the last micro-batch. Its windows go with :func:`without_sentinel`."""

    def value(f: T.StructField) -> F.Column:
        if f.name != ts:
            return F.lit(None).cast(f.dataType)
        timestamp = isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType))
        return F.timestamp_millis(F.lit(at)).cast(f.dataType) if timestamp else F.lit(at).cast(f.dataType)

    return spark.range(1).select(*(value(f).alias(f.name) for f in schema.fields))


def without_sentinel(windows: DataFrame, last: int) -> DataFrame:
    """The windows of real rows: they begin by the latest real time, those of the closing row after it, whatever the year."""
    return windows.where(F.col("window_start") <= last)


def drain(df: DataFrame, name: str, checkpoint: str | None = None, mode: str = "append") -> DataFrame:
    """Run a stream until its input is used up and return what it gave, from a memory table."""
    writer = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    query = writer.start()
    query.awaitTermination()
    return df.sparkSession.table(name)


def drain_append(df: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run a stream until its input is used up, in append mode, to files that its log commits exactly once; call it again for more input."""
    df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drain_complete(df: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run a streaming aggregation until its input is used up and return all its groups, closed or not, as a written table.

    Each micro-batch writes the whole result under its number; the last one written counts.
    """
    last: list[str] = []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{number}")
        last[:] = [f"{path}/{number}"]

    df.writeStream.foreachBatch(write).outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.read.parquet(last[0]) if last else df.sparkSession.createDataFrame([], df.schema)


def run_to_end(rows: DataFrame, build: Callable[[DataFrame], DataFrame], path: str, *, ts: str, last: int, delay: int, size: int) -> DataFrame:
    """The windows that ``build`` makes of a stream over bounded input, in append mode and all of them: those that the watermark closes
    by itself and, after one more row at the :func:`closing_time`, the rest. ``last`` is the latest time (column ``ts``) of the input,
    ``size`` the windows' size, or their slide where that is longer; ``path`` a fresh folder."""
    spark, closing = rows.sparkSession, f"{path}/closing"
    spark.createDataFrame([], rows.schema).write.parquet(closing)
    windows = build(rows.unionByName(spark.readStream.schema(rows.schema).parquet(closing)))
    drain_append(windows, f"{path}/result", f"{path}/checkpoint")
    sentinel(spark, rows.schema, ts, closing_time(last, delay, size)).write.mode("append").parquet(closing)
    return without_sentinel(drain_append(windows, f"{path}/result", f"{path}/checkpoint"), last)
