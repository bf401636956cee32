"""Corrected windows on a live stream: each micro-batch publishes the windows it fired or changed, together with its state.

State is what :mod:`tidemark.operators.late` computes over history: the latest time and batch per source, the low mark per group, and the
partial aggregates of windows that can still change. It is committed with the output by a :class:`~tidemark.operators.incremental.RunStore`, once per batch: a batch that is
repeated after a failure finds its commit and does nothing.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.incremental import RunStore
from tidemark.operators.late import DIVERTED, LATE, ON_TIME, UNTIMED, LateSpec
from tidemark.session import broadcast_within, cut


@dataclass
class MarkedStream:
    """Each row of a live stream with its arrival, by marks that are aggregated per source and joined: nothing goes row by row, and a
    source with any share of the rows is spread over tasks.

    Feed micro-batches to :meth:`take`, or :meth:`start` it on a stream. The state is the latest time and batch per source and the low
    mark per group, which never falls; it is committed with the output, once per batch. ``limits`` and the columns of ``spec`` are
    those of :func:`tidemark.operators.late.classify`, the micro-batch's number being the batch. ``columns`` are kept of each row.
    """

    store: RunStore
    limits: DataFrame
    spec: LateSpec = LateSpec()
    columns: tuple[str, ...] = ()

    def _low(self, marks: DataFrame, held: DataFrame, batch_id: int) -> DataFrame:
        """(group, mark): the low mark before ``batch_id``, the smallest of the sources that aren't idle, and never below ``held``.

        Where all are idle, those seen last count: theirs is the low mark that held before they fell idle.
        """
        g, active = self.spec.group, marks
        if self.spec.idle_batches is not None:
            newest = marks.groupBy(g).agg(F.max("seen").alias("newest"))
            active = marks.join(newest, g).where(F.col("seen") >= F.least(F.lit(batch_id - self.spec.idle_batches), F.col("newest")))
        if self.spec.expected > 1:
            active = active.join(marks.groupBy(g).agg(F.count(F.lit(1)).alias("sources")).where(F.col("sources") >= self.spec.expected), g, "left_semi")
        return held.unionByName(active.groupBy(g).agg(F.min("mark").alias("mark"))).groupBy(g).agg(F.max("mark").alias("mark"))

    def _fresh(self, batch_id: int, query: str | None, last: dict | None) -> bool:
        """Whether the batch is new. Batch numbers only tell that within one query, whose id the commits keep."""
        if last is None:
            return True
        if query != last.get("query"):
            raise ValueError(f"the store holds batches of query {last.get('query')}, not of {query}: a new checkpoint folder numbers its batches anew, so give it a new store")
        return batch_id > last["tag"]

    def _bounds(self) -> DataFrame:
        s = self.spec
        named = (("delay", s.delay), ("size", s.size), ("late", s.lateness))
        return broadcast_within(self.limits.select(s.group, *(F.col(c).cast("bigint").alias(f"__{k}") for k, c in named)), s.max_broadcast_rows)

    def _judge(self, batch: DataFrame, batch_id: int, last: dict | None, columns: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
        """The rows with window, ``watermark`` and ``arrival``; the marks and the low marks after the batch."""
        spec, spark = self.spec, self.store.spark
        g, source = spec.group, [spec.group, *spec.sources]
        state = {k: spark.read.parquet(p) for k, p in last["parts"].items()} if last else {}
        taken = batch.select(*dict.fromkeys([*source, spec.ts, *columns])).withColumn("__ts", F.col(spec.ts).cast("bigint"))
        timed = taken.where(F.col("__ts").isNotNull() & F.col(g).isNotNull())
        fresh = timed.groupBy(*source).agg(F.max("__ts").alias("mark")).withColumn("seen", F.lit(batch_id).cast("bigint"))
        old = state.get("marks", fresh.limit(0))
        held = state.get("low", fresh.select(g, "mark").limit(0))
        before = cut(self._low(old, held, batch_id))
        marks = cut(old.unionByName(fresh).groupBy(*source).agg(F.max("mark").alias("mark"), F.max("seen").alias("seen")))
        low = cut(self._low(marks, before, batch_id + 1))
        rows = taken.join(self._bounds(), g, "left").join(broadcast_within(before.withColumnRenamed("mark", "__mark"), spec.max_broadcast_rows), g, "left")
        start = F.col("__ts") - F.pmod(F.col("__ts"), F.col("__size"))
        end, wm = start + F.col("__size"), F.col("__mark") - F.col("__delay") - 1
        arrival = F.when(end.isNull(), UNTIMED).when(wm.isNull() | (end > wm), ON_TIME).when(end + F.col("__late") > wm, LATE).otherwise(DIVERTED)
        return rows.withColumns({"window_start": start, "window_end": end, "watermark": wm, "arrival": arrival}), marks, low

    def take(self, batch: DataFrame, batch_id: int, query: str | None = None) -> dict | None:
        """Process one micro-batch; None if it was committed before. Output ``output``: every row with ``watermark`` (what held before the
        batch), ``arrival`` and ``below``, whether its own time is below the watermark: the strict rule for single records."""
        last = self.store.last()
        if not self._fresh(batch_id, query, last):
            return None
        cols = list(dict.fromkeys([self.spec.group, *self.spec.sources, self.spec.ts, *self.columns]))
        rows, marks, low = self._judge(batch, batch_id, last, cols)
        out = rows.select(*cols, "watermark", "arrival", F.coalesce(F.col("__ts") < F.col("watermark"), F.lit(False)).alias("below"))
        return self.store.publish_parts({"output": out}, {"marks": marks, "low": low}, tag=batch_id, query=query)

    def start(self, stream: DataFrame, checkpoint: str, **trigger: Any) -> Any:
        """Run it on a stream. The store belongs to the query of this checkpoint folder; a query of another one is refused."""

        def each(df: DataFrame, number: int) -> None:
            self.take(df, number, df.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId"))

        return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


@dataclass
class CorrectedStream(MarkedStream):
    """Windows of a live stream, first as they fire and again when late rows correct them. ``keys`` begin with the group column of ``spec``."""

    keys: tuple[str, ...] = ("job_id", "name")
    value: str = "value"

    def take(self, batch: DataFrame, batch_id: int, query: str | None = None) -> dict | None:
        """Process one micro-batch; None if it was committed before. Outputs: ``output``, the changed windows' new values; ``diverted``,
        the rows beyond the allowance; ``untimed``, those with a null time or group or of a group without limits.

        A window fires in the batch after which its group's watermark first reaches its end; later changes are corrections.
        """
        spec, last = self.spec, self.store.last()
        if not self._fresh(batch_id, query, last):
            return None
        g, cols = spec.group, list(dict.fromkeys([*self.keys, spec.ts, self.value]))
        rows, marks, low = self._judge(batch, batch_id, last, cols)
        by, v = [*self.keys, "window_start", "window_end"], F.col(self.value).cast("bigint")
        fresh = rows.where(F.col("arrival").isin(ON_TIME, LATE)).groupBy(*by).agg(
            F.sum(v).alias("sum_value"), F.max(v).alias("max_value"), F.min(v).alias("min_value"), F.count(F.lit(1)).alias("row_count"), F.max((F.col("arrival") == LATE).cast("int")).alias("late")
        ).withColumn("changed", F.lit(True))
        if last:
            open_ = self.store.spark.read.parquet(last["parts"]["windows"]).withColumn("changed", F.lit(False)).withColumn("late", F.lit(0))
        else:
            open_ = fresh.limit(0).withColumn("fired", F.lit(False))
        folds = (("sum_value", F.sum), ("max_value", F.max), ("min_value", F.min), ("row_count", F.sum), ("changed", F.max), ("late", F.max))
        both = open_.unionByName(fresh.withColumn("fired", F.lit(False))).groupBy(*by).agg(*(f(c).alias(c) for c, f in folds), F.max("fired").alias("was"))
        now = both.join(self._bounds(), g).join(broadcast_within(low, spec.max_broadcast_rows), g)
        reached = F.col("mark") - F.col("__delay") - 1
        fired = F.coalesce(reached >= F.col("window_end"), F.lit(False))
        judged = cut(now.withColumns({"fired": fired, "over": F.coalesce(reached >= F.col("window_end") + F.col("__late"), fired)}))
        emitted = judged.where((F.col("fired") & ~F.col("was")) | (F.col("fired") & F.col("changed")))
        kept = [*by, "sum_value", "max_value", "min_value", "row_count"]
        outputs = {
            "output": emitted.select(*kept, F.col("was").alias("correction"), F.lit(batch_id).cast("bigint").alias("batch")),
            "diverted": rows.where(F.col("arrival") == DIVERTED).select(*cols),
            "untimed": rows.where(F.col("arrival") == UNTIMED).select(*cols),
        }
        return self.store.publish_parts(outputs, {"marks": marks, "low": low, "windows": judged.where(~F.col("over")).select(*kept, "fired")}, tag=batch_id, query=query)

    def flush(self, batch_id: int) -> DataFrame:
        """At the end of the input: the windows that are still open and have not fired."""
        last = self.store.last()
        return self.store.spark.read.parquet(last["parts"]["windows"]).where(~F.col("fired")).drop("fired").withColumn("batch", F.lit(batch_id).cast("bigint"))
