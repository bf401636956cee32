"""The registered queries of live streams: strict watermarks, alignment, windows to the end of the input, stateful processes, counters."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import aggregates as A
from tidemark.functions import windows
from tidemark.operators.incremental import RunStore
from tidemark.operators.late import LateSpec
from tidemark.plans.registry import Registry
from tidemark.plans.stream import Stream
from tidemark.session import scratch, table
from tidemark.sources import memory
from tidemark.streaming import metrics, runner, state
from tidemark.streaming.corrections import MarkedStream
from tidemark.streaming.watermarks import WatermarkGenerator, bounded, generated

REGISTRY = Registry()
query = REGISTRY.query
HOUR, DAY = 3_600_000, 86_400_000
MODEL = ("timestamp", "name", "value")


def _stream(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return spark.readStream.schema(table(spark, d, "stream_table").schema).parquet(f"{d}/stream_table.parquet*").select(*columns)


def _last(spark: SparkSession, d: str) -> int:
    return table(spark, d, "stream_table").agg(F.max("timestamp")).first()[0] or 0


# -- strict watermarks

# The rows of the window fixture, in order of arrival, and the windows that are left of them under strict lateness.
START = 1_583_899_260_000
SECONDS = (0, 5, 15, 20, 25, 35, 40, 45, 55, 60, 65, 75, 80, 85, 95)
NAMES = ("A-key-0", "B-key-0", "C-key-0")
GOLDEN = {
    "A-key-0": ((-40, 6, 3, 1, 3), (-20, 21, 6, 1, 6), (0, 45, 9, 1, 9), (20, 72, 12, 4, 9), (40, 99, 15, 7, 9), (60, 75, 15, 10, 6), (80, 42, 15, 13, 3)),
    "others": ((-40, 6, 3, 1, 3), (-20, 17, 6, 1, 5), (0, 26, 9, 1, 6), (20, 53, 12, 5, 6), (40, 84, 15, 9, 7), (60, 75, 15, 10, 6), (80, 42, 15, 13, 3)),
}

_GOLDEN_SQL = "SELECT name, CAST(s AS BIGINT) AS sum_value, CAST(mx AS BIGINT) AS max_value, CAST(mn AS BIGINT) AS min_value, CAST(n AS BIGINT) AS row_count, window_start, window_start + 60000 AS window_end FROM (VALUES {}) AS t(name, window_start, s, mx, mn, n)".format(
    ", ".join(f"('{n}', {START + at * 1000}, {s}, {mx}, {mn}, {c})" for n in NAMES for at, s, mx, mn, c in GOLDEN.get(n, GOLDEN["others"]))
)


@query(_GOLDEN_SQL)
def stream_strict_fixture(spark: SparkSession, d: str) -> DataFrame:
    """The fixture replayed on a stream: a periodic watermark moves between the rows of a micro-batch and six of them are late."""
    state.use_rocksdb(spark)
    at, rows = scratch(spark), []
    for block in range(0, 15, 3):
        rows += [(START + SECONDS[v] * 1000, n, v + 1, len(rows) + i, "all") for i, (n, v) in enumerate((n, v) for n in NAMES for v in range(block, block + 3))]
    memory.vec_source(spark, rows, "timestamp bigint, name string, value bigint, arrival int, source string").write.parquet(f"{at}/in")
    stream = spark.readStream.schema("timestamp bigint, name string, value bigint, arrival int, source string").parquet(f"{at}/in")
    strategy = bounded(1000).wrap_time_periodic(10_000, 20_000)
    four = [A.sum_("value").named("sum_value"), A.max_("value").named("max_value"), A.min_("value").named("min_value"), A.count().named("row_count")]

    def build(df: DataFrame) -> DataFrame:
        kept = Stream(df).assign_timestamps(strategy, source=["source"], order=["arrival"])
        return kept.key_by("name").window(windows.hop(60_000, 20_000)).reduce(*four).df

    return runner.run_to_end(stream, build, at, ts="timestamp", last=START + SECONDS[-1] * 1000, delay=1000, size=60_000)


@query("""WITH marks AS (SELECT job_id, batch_id, MAX("timestamp") AS mark FROM stream_table WHERE "timestamp" IS NOT NULL GROUP BY ALL),
    before AS (SELECT job_id, batch_id, MAX(mark) OVER (PARTITION BY job_id ORDER BY batch_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mark FROM marks)
    SELECT row_id, GREATEST(0, CASE WHEN mark > 1000 THEN mark - 1001 ELSE 0 END) AS watermark FROM stream_table s JOIN before b ON s.job_id = b.job_id AND s.batch_id = b.batch_id
    WHERE "timestamp" IS NOT NULL AND "timestamp" < CASE WHEN mark > 1000 THEN mark - 1001 ELSE 0 END""")
def strict_late_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows below their job's watermark, taken one by one in order of arrival, each batch ending with a tick."""
    rows = table(spark, d, "stream_table").select("row_id", "timestamp", "job_id", "batch_id")
    return state.strict(rows, bounded(1000), ["job_id"], order=["row_id"], tick="batch_id").where("late").select("row_id", "watermark")


class _Punctuated(WatermarkGenerator):
    """A watermark with every row: its time less five minutes."""

    def on_event(self, ts: int, now: int) -> int | None:
        return ts - 300_000


@query("""SELECT row_id FROM (SELECT *, MAX("timestamp") OVER (PARTITION BY job_id ORDER BY row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest FROM stream_table WHERE "timestamp" IS NOT NULL)
    WHERE "timestamp" < GREATEST(0, latest - 300000)""")
def watermark_custom(spark: SparkSession, d: str) -> DataFrame:
    """Late rows under a generator of one's own, which publishes with every row."""
    rows = table(spark, d, "stream_table").select("row_id", "timestamp", "job_id")
    return state.strict(rows, generated(_Punctuated), ["job_id"], order=["row_id"]).where("late").select("row_id")


@query("SELECT * FROM (VALUES (0, CAST(NULL AS BIGINT)), (1, NULL), (2, 9), (3, 9), (4, 12)) AS t(batch, watermark)")
def watermark_alignment(spark: SparkSession, d: str) -> DataFrame:
    """Two tasks report 10 and then 9: no watermark before both have, then the smaller one, which never falls."""
    limits = spark.createDataFrame([(1, -1, 5, 0)], "job_id int, out_of_orderness_millis bigint, window_size_millis bigint, allowed_lateness_millis bigint")
    stream = MarkedStream(RunStore(spark, scratch(spark)), limits, LateSpec(sources=("task",), expected=2))
    out = []
    for batch, reports in enumerate([[(0, 10)], [(1, 9)], [(0, 12)], [(1, 20), (0, 3)], [(0, 30)]]):
        rows = spark.createDataFrame([(1, task, t) for task, t in reports], "job_id int, task int, timestamp bigint")
        out.append((batch, stream.store.output(commit=stream.take(rows, batch)).first()["watermark"]))
    return spark.createDataFrame(out, "batch int, watermark bigint")


# -- windows to the end of the input


def _hop_sql(size: int, end: str) -> str:
    return f"""SELECT name, CAST(SUM(value) AS BIGINT) AS sum_value, COUNT(*) AS row_count, window_start, {end} AS window_end
        FROM (SELECT name, value, "timestamp" AS t, "timestamp" - "timestamp" % {size} AS window_start FROM stream_table WHERE "timestamp" >= 0) WHERE t < {end} GROUP BY ALL"""


@query(_hop_sql(6 * HOUR, f"window_start + {2 * HOUR}"))
def stream_gapped(spark: SparkSession, d: str) -> DataFrame:
    """Windows with gaps on a stream."""

    def build(df: DataFrame) -> DataFrame:
        return Stream(df).assign_timestamps(bounded(0)).key_by("name").window(windows.hop(2 * HOUR, 6 * HOUR)).reduce(A.sum_("value").named("sum_value"), A.count().named("row_count")).df

    return runner.run_to_end(_stream(spark, d, *MODEL), build, scratch(spark), ts="timestamp", last=_last(spark, d), delay=0, size=6 * HOUR)


def _odd_days(ts: F.Column) -> F.Column:
    start = windows.window_start(ts, 0, DAY)
    return F.array(F.struct(start.alias("start"), (start + F.when(F.call_function("div", start, F.lit(DAY)) % 2 == 0, DAY).otherwise(HOUR)).alias("end")))


@query(_hop_sql(DAY, f"window_start + CASE WHEN window_start // {DAY} % 2 = 0 THEN {DAY} ELSE {HOUR} END").replace(f"WHERE t < window_start + CASE WHEN window_start // {DAY} % 2 = 0 THEN {DAY} ELSE {HOUR} END ", ""))
def stream_custom_window(spark: SparkSession, d: str) -> DataFrame:
    """Windows of a custom assigner on a stream, whose aggregates are keyed state under timers."""
    state.use_rocksdb(spark)

    def build(df: DataFrame) -> DataFrame:
        return Stream(df).assign_timestamps(bounded(0)).key_by("name").window(_odd_days).reduce(A.sum_("value").named("sum_value"), A.count().named("row_count")).df

    return runner.run_to_end(_stream(spark, d, *MODEL), build, scratch(spark), ts="timestamp", last=_last(spark, d), delay=0, size=DAY)


@query(f"""SELECT name, CAST(BIT_XOR(COALESCE(value, 0)) AS BIGINT) AS mixed, "timestamp" - "timestamp" % {DAY} AS window_start, "timestamp" - "timestamp" % {DAY} + {DAY} AS window_end
    FROM stream_table WHERE "timestamp" >= 0 GROUP BY ALL""")
def stream_fold(spark: SparkSession, d: str) -> DataFrame:
    """A custom fold per key and window on a stream."""
    state.use_rocksdb(spark)

    def build(df: DataFrame) -> DataFrame:
        keyed = Stream(df).assign_timestamps(bounded(0)).key_by("name").window(windows.tumble(DAY))
        return keyed.fold(lambda acc, row: {"mixed": (acc["mixed"] if acc else 0) ^ (row["value"] or 0)}, lambda a, b: {"mixed": a["mixed"] ^ b["mixed"]}, "mixed bigint").df

    return runner.run_to_end(_stream(spark, d, *MODEL), build, scratch(spark), ts="timestamp", last=_last(spark, d), delay=0, size=DAY)


# -- several inputs


class _LastSetting(state.CoProcess):
    """Left rows with the value that the second input showed last for their key, and how many left rows the key had before."""

    def left(self, row: Row, state: dict) -> Iterable[dict]:
        state["seen"] = state.get("seen", 0) + 1
        yield {"row_id": row["row_id"], "setting": state.get("setting"), "before": state["seen"] - 1}

    def right(self, number: int, row: Row, state: dict) -> Iterable[dict]:
        state["setting"] = row["setting"]
        return ()


_CO_SQL = """SELECT row_id, setting, before FROM (
    SELECT row_id, job_id, LAST_VALUE(CASE WHEN job_id > 4 THEN row_id END IGNORE NULLS) OVER w AS setting, COUNT(*) FILTER (job_id <= 4) OVER w - 1 AS before
    FROM stream_table WHERE job_id IS NOT NULL WINDOW w AS (PARTITION BY name ORDER BY row_id ROWS UNBOUNDED PRECEDING)) WHERE job_id <= 4"""


@query(_CO_SQL)
def connect_stateful(spark: SparkSession, d: str) -> DataFrame:
    """Two streams in one process with state per key, in order of arrival: the jobs above 4 are settings for the rows of the others."""
    state.use_rocksdb(spark)
    rows = _stream(spark, d, "row_id", "name", "job_id")
    left = Stream(rows.where("job_id <= 4").select("row_id", "name"))
    right = Stream(rows.where("job_id > 4").select("row_id", "name", F.col("row_id").alias("setting")))
    out = left.connect(right).stateful(["name"], _LastSetting, "row_id bigint, setting bigint, before bigint", ["row_id"])
    at = scratch(spark)
    return runner.drain_append(out.df, f"{at}/result", f"{at}/checkpoint")


@query(_CO_SQL)
def connect_stateful_bounded(spark: SparkSession, d: str) -> DataFrame:
    """The same process over bounded tables."""
    state.use_rocksdb(spark)
    rows = table(spark, d, "stream_table").select("row_id", "name", "job_id")
    left = Stream(rows.where("job_id <= 4").select("row_id", "name"))
    right = Stream(rows.where("job_id > 4").select("row_id", "name", F.col("row_id").alias("setting")))
    return left.connect(right).stateful(["name"], _LastSetting, "row_id bigint, setting bigint, before bigint", ["row_id"]).df


@query("""WITH newest AS (SELECT name, ARG_MAX(task_number, row_id) AS setting FROM stream_table WHERE job_id > 4 GROUP BY name)
    SELECT s.row_id, CAST(n.setting AS VARCHAR) AS setting FROM stream_table s LEFT JOIN newest n ON s.name IS NOT DISTINCT FROM n.name WHERE s.job_id <= 4""")
def connect_evolving(spark: SparkSession, d: str) -> DataFrame:
    """Rows with the newest configuration of their key: within a micro-batch, here the whole table, configuration comes first, by its order."""
    state.use_rocksdb(spark)
    rows = _stream(spark, d, "row_id", "name", "job_id", "task_number")
    config = rows.where("job_id > 4").select("name", F.col("task_number").alias("setting"), F.col("row_id").alias("at"))
    out = state.enrich_evolving(rows.where("job_id <= 4").select("row_id", "name"), config, "name", "setting", "at")
    at = scratch(spark)
    return runner.drain_append(out.drop("name"), f"{at}/result", f"{at}/checkpoint")


# -- counters


@query("""SELECT COUNT(*) AS read, COUNT("timestamp") AS timed, COUNT(*) AS row_count FROM stream_table""")
def stream_meters(spark: SparkSession, d: str) -> DataFrame:
    """Rows counted where they pass, on a stream, and the same by an observation over the bounded table."""
    name = f"meter_{uuid.uuid4().hex}"
    stream = Stream(_stream(spark, d, *MODEL)).observed(name, F.count("timestamp").alias("timed"))
    at = scratch(spark)
    with metrics.Meters(spark) as meters:
        runner.drain_append(stream.df, f"{at}/result", f"{at}/checkpoint")
        meters.wait(name)
    counts = meters.counts[name]
    rows, seen = metrics.measured(table(spark, d, "stream_table").select("row_id"), f"{name}_batch", F.count(F.lit(1)).alias("n"))
    rows.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(counts["rows"], counts["timed"], seen.get["n"])], "read bigint, timed bigint, row_count bigint")
