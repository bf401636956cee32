"""The queries p2 to p6 and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import checkpoints, dedup, heavy, incremental, late, rolling
from tidemark.session import broadcast_within, cut, scratch, side_by_side, table
from tidemark.streaming import corrections

Query = Callable[[SparkSession, str], DataFrame]

KEPT = ("row_id", "name", "value")
BY_TASK = late.LateSpec(sources=("task_number",), idle_batches=48, monotone=True)
PRODUCER = ("topic", "partition")
RUNS = 4
MAX_RANGES = 1_000_000  # ranges that are broadcast, if their bytes allow; beyond, the join shuffles


def _classified(spark: SparkSession, d: str, spec: late.LateSpec = late.LateSpec()) -> DataFrame:
    return late.classify(table(spark, d, "stream_table"), table(spark, d, "bounded_out_of_orderness_watermarks"), spec, KEPT)


def _named(df: DataFrame) -> DataFrame:
    return df.where(F.col("name").isNotNull() & (F.col("name") != ""))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return late.classify(table(spark, d, "stream_table"), table(spark, d, "bounded_out_of_orderness_watermarks")).where(F.col("arrival") == late.LATE).select("row_id")


def p2_windows(spark: SparkSession, d: str) -> DataFrame:
    out = late.corrected_windows(_named(_classified(spark, d)))
    return out.withColumns({c: F.col(c).cast("bigint") for c in ("first_sum_value", "final_sum_value")})


def p2_first_fired(spark: SparkSession, d: str) -> DataFrame:
    out = late.corrected_windows(_named(_classified(spark, d))).where(F.col("first_row_count") > 0)
    out = out.withColumn("first_sum_value", F.col("first_sum_value").cast("bigint"))
    return out.select("job_id", "name", "window_start", "window_end", *(F.col(f"first_{c}").alias(c) for c in _VALUES))


def p2_revisions(spark: SparkSession, d: str) -> DataFrame:
    return late.revisions(_named(_classified(spark, d))).withColumn("sum_value", F.col("sum_value").cast("bigint"))


def p2_diverted(spark: SparkSession, d: str) -> DataFrame:
    return _classified(spark, d).where(F.col("arrival").isin(late.DIVERTED, late.UNTIMED)).select("row_id", "arrival")


def p2_by_task(spark: SparkSession, d: str) -> DataFrame:
    """Arrivals per job when each task is a source of its own that holds the watermark back until it is idle for two days."""
    return _classified(spark, d, BY_TASK).groupBy("job_id", "arrival").agg(F.count(F.lit(1)).alias("n"))


def _located(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    """Deliveries by range, each range's topic and partition from consumer_range; the wrong ones of the delivery are not read."""
    return table(spark, d, "consumer_range").select("range_id", "topic", "partition"), table(spark, d, "kafka_message").select("range_id", *cols)


def _words(spark: SparkSession, d: str) -> DataFrame:
    """Words of the delivered offsets: combined per range first, so that the join with the ranges moves words, not deliveries."""
    ranges, deliveries = _located(spark, d, "offset")
    per_range = incremental.words(deliveries, ("range_id",), "offset")
    return cut(incremental.merge_words(per_range.join(ranges, "range_id").select(*PRODUCER, "word", "bits"), PRODUCER))


def _pending(spark: SparkSession, d: str) -> DataFrame:
    """Two runs of a store. The first commits what the completed checkpoints had processed, the words up to the saved offsets, with its
    tree; the second compares the tree of all deliveries with it and gives out what is new."""
    now, saved = side_by_side(lambda: _words(spark, d), lambda: cut(checkpoints.saved_offsets(table(spark, d, "rlink_ck"))))  # the latter a row per partition
    store = incremental.RunStore(spark, scratch(spark))
    incremental.run_words(store, cut(incremental.upto(now, saved, PRODUCER, "saved")), PRODUCER, "offset", None)
    return store.output(commit=incremental.run_words(store, now, PRODUCER, "offset", lambda fresh: fresh))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _pending(spark, d).select("topic", "partition", "offset")


def p3_saved_offsets(spark: SparkSession, d: str) -> DataFrame:
    return checkpoints.saved_offsets(table(spark, d, "rlink_ck"))


def p3_pending_messages(spark: SparkSession, d: str) -> DataFrame:
    """One delivery, the first, of each message that the next run has to process."""
    ranges, deliveries = _located(spark, d, "offset", "delivery_id")
    first = dedup.combine_copies(deliveries.where(F.col("offset").isNotNull()), ("range_id",), "offset", "delivery_id").join(ranges, "range_id")
    each = first.groupBy(*PRODUCER, "offset").agg(F.min("first").alias("delivery_id"))
    return each.join(_pending(spark, d), [*PRODUCER, "offset"], "left_semi").select(*PRODUCER, "offset", "delivery_id")


TASK = ("application_name", "application_id", "job_id", "task_number", "operator_id")


def _states_by(spark: SparkSession, d: str, until: int | None) -> DataFrame:
    """Of each task the state that it saved last, among those saved for checkpoints up to ``until``."""
    rows = table(spark, d, "rlink_ck")
    rows = rows if until is None else rows.where(F.col("checkpoint_id") <= until)
    last = rows.groupBy(*TASK).agg(F.max(F.struct("checkpoint_id", "id", "completed_checkpoint_id", "handle")).alias("s"))
    return last.select(*TASK, "s.checkpoint_id", "s.completed_checkpoint_id", "s.handle")


MIDDLE = 1_421_798_400_000  # 2015-01-21, the middle of the data


def p3_changed_states(spark: SparkSession, d: str) -> DataFrame:
    """The tasks whose saved state was added or changed between the checkpoints up to the middle of the data and all, as the second of two runs gives them out."""
    store = incremental.RunStore(spark, scratch(spark))
    content = ("checkpoint_id", "completed_checkpoint_id", "handle")

    def process(fresh: DataFrame, changes: DataFrame) -> DataFrame:
        kinds = changes.select(F.col("key_hash").alias("__k"), "change")
        return fresh.withColumn("__k", incremental.key_hash(TASK)).join(kinds, "__k").drop("__k")

    for until in (MIDDLE, None):
        incremental.run_keyed(store, _states_by(spark, d, until), TASK, content, process)
    return store.output()


def p3_appended(spark: SparkSession, d: str) -> DataFrame:
    """The messages that are new in the last fifth of the batches, found from these batches alone and the words and tree that a run over the others left."""
    ranges, deliveries = _located(spark, d, "offset", "batch_id")
    parts = dedup.runs_of(deliveries, "batch_id", 5)
    store = incremental.RunStore(spark, scratch(spark))
    for run, take in (("first", reduce(lambda a, b: a | b, parts[:-1], F.lit(False))), ("last", parts[-1])):
        per_range = incremental.words(deliveries.where(take), ("range_id",), "offset")
        batch = cut(incremental.merge_words(per_range.join(ranges, "range_id").select(*PRODUCER, "word", "bits"), PRODUCER))
        incremental.run_words(store, batch, PRODUCER, "offset", lambda fresh: fresh, appended=run == "last")
    return store.output()


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return heavy.heavy_keys(table(spark, d, "stream_table")).where(F.col("name") != "").select("name")


def p4_per_name(spark: SparkSession, d: str) -> DataFrame:
    return heavy.per_key(table(spark, d, "stream_table")).withColumn("sum_value", F.col("sum_value").cast("bigint"))


def _dedup_runs(spark: SparkSession, d: str) -> list[dedup.Accepted]:
    """All deliveries in consecutive runs of a store, each seeing only what earlier runs committed. Copies are combined per run and range before the join."""
    all_rows = table(spark, d, "kafka_message")
    ranges = table(spark, d, "consumer_range").select("range_id", *PRODUCER)
    content = F.sha2(F.concat_ws("|", *(F.coalesce(c, F.lit("null")) for c in (F.hex("key"), F.hex("payload"), F.col("timestamp").cast("string")))), 256)
    place = [F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in (*PRODUCER, "offset")]
    per_range = [F.min("delivery_id").alias("delivery_id"), F.count(F.lit(1)).alias("copies")]
    conditions = dedup.runs_of(all_rows, "batch_id", RUNS)
    run = F.lit(len(conditions) - 1)
    for i in range(len(conditions) - 2, -1, -1):
        run = F.when(conditions[i], i).otherwise(run)
    rows = all_rows.withColumn("run", run)
    parts = rows.where(F.col("offset").isNotNull()).groupBy("run", "range_id", "offset").agg(*per_range).withColumn("exact", F.lit(None).cast("string"))
    odd = rows.where(F.col("offset").isNull()).groupBy("run", "range_id", content.alias("exact")).agg(*per_range)
    located = parts.unionByName(odd, allowMissingColumns=True).join(broadcast_within(ranges, MAX_RANGES), "range_id", "left")
    located = cut(located.withColumn("exact_key", F.when(F.col("exact").isNotNull(), F.sha2(F.concat_ws("|", *place, "exact"), 256))).drop("exact"))
    # a delivery of an unknown range has an offset, but no producer: its range and offset are its exact key
    whole = F.coalesce("exact_key", F.sha2(F.concat_ws("|", *place, F.lit("range"), F.coalesce(F.col("range_id").cast("string"), F.lit("null"))), 256))
    store = incremental.RunStore(spark, scratch(spark))
    return [
        dedup.run_deliveries(store, located.where(F.col("run") == i), producer=PRODUCER, seq="offset", arrival="delivery_id", copies="copies", exact_key=whole, tag=i)
        for i in range(len(conditions))
    ]


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _union([r.repeated for r in _dedup_runs(spark, d)]).distinct()


def p5_unique(spark: SparkSession, d: str) -> DataFrame:
    """The one delivery of each message that is let through; deliveries without an offset are told apart by their content."""
    return _union([r.arrivals for r in _dedup_runs(spark, d)]).select(F.col("first").alias("delivery_id"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    days = rolling.rolling_totals(_named(table(spark, d, "stream_table").select("name", "timestamp", "value")))
    return days.where(F.col("rows_today") == 0).select("name", F.date_format("day", "yyyy-MM-dd").alias("day"))


def p6_rolling(spark: SparkSession, d: str) -> DataFrame:
    days = rolling.rolling_totals(_named(table(spark, d, "stream_table").select("name", "timestamp", "value")))
    measures = (x for w in (7, 30) for x in (F.col(f"total_{w}d").cast("bigint").alias(f"total_{w}d"), F.col(f"n_{w}d"), F.col(f"avg_{w}d")))
    return days.select("name", F.date_format("day", "yyyy-MM-dd").alias("day"), "rows_today", *measures)


def p6_undated(spark: SparkSession, d: str) -> DataFrame:
    """The rows that no rolling total can hold, by name and reason."""
    return rolling.undated(table(spark, d, "stream_table")).withColumn("total", F.col("total").cast("bigint"))


#: Micro-batches of the live form of problem 2: so many ids of the table's batches make one.
PER_MICRO_BATCH = 240


def _live(spark: SparkSession, d: str, stream: corrections.MarkedStream) -> list[dict]:
    """The table fed to ``stream`` in micro-batches, in order of arrival."""
    rows = table(spark, d, "stream_table").withColumn("micro", F.floor(F.col("batch_id") / PER_MICRO_BATCH).cast("int"))
    last = rows.agg(F.max("micro")).first()[0]
    return [stream.take(rows.where(F.col("micro") == i), i) for i in range((-1 if last is None else last) + 1)]


def p2_live_windows(spark: SparkSession, d: str) -> DataFrame:
    """Windows of the live form: their values as they were published last, and how often they were corrected after they had fired."""
    stream = corrections.CorrectedStream(incremental.RunStore(spark, scratch(spark)), table(spark, d, "bounded_out_of_orderness_watermarks"))
    commits = _live(spark, d, stream)
    read = [spark.read.parquet(c["outputs"]["output"]) for c in commits]
    rest = stream.flush(len(commits)).withColumn("correction", F.lit(False))
    each = _named(_union([*read, rest.select(*read[0].columns)] if read else [rest]))
    by = ("job_id", "name", "window_start", "window_end")
    newest = F.max(F.struct("batch", *_VALUES)).alias("v")
    return each.groupBy(*by).agg(newest, F.count(F.when(F.col("correction"), 1)).alias("corrections")).select(*by, *(F.col(f"v.{c}") for c in _VALUES), "corrections")


_VALUES = ("sum_value", "max_value", "min_value", "row_count")


def p2_live_arrivals(spark: SparkSession, d: str) -> DataFrame:
    """The arrival of each row on the live stream, each task being a source that is left out after two idle micro-batches."""
    spec = late.LateSpec(sources=("task_number",), idle_batches=2)
    stream = corrections.MarkedStream(incremental.RunStore(spark, scratch(spark)), table(spark, d, "bounded_out_of_orderness_watermarks"), spec, ("row_id",))
    return _union([spark.read.parquet(c["outputs"]["output"]) for c in _live(spark, d, stream)]).select("row_id", "arrival", "below")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        p2_found, p2_windows, p2_first_fired, p2_revisions, p2_diverted, p2_by_task, p2_live_windows, p2_live_arrivals, p3_found, p3_saved_offsets, p3_pending_messages,
        p3_changed_states, p3_appended, p4_found, p4_per_name, p5_found, p5_unique, p6_found, p6_rolling, p6_undated,
    )
}
