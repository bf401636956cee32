"""Late and out-of-order events: per-source low watermarks, closed periods, corrections and a lateness cut-off.

Rows arrive in batches. A source's mark before batch b is the largest event time it showed in batches before b; the low watermark of
a group before b is the smallest mark of its sources, less the group's bound on disorder, less 1; with ``monotone`` never below what it
was before an earlier batch. A period [start, end) closes once
the watermark reaches its end. A row of a closed period corrects it while end + allowance > watermark; later rows are diverted.

The marks are pre-aggregated to one row per group, source and batch ("punctuations"), so nothing is sorted by arrival over raw rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.exact import from_parts, sum_parts
from tidemark.session import broadcast_within, cut

ON_TIME, LATE, DIVERTED, UNTIMED = "on_time", "late", "diverted", "untimed"


@dataclass(frozen=True)
class LateSpec:
    """Column names and idle timeout.

    ``sources``: columns that tell apart the sources of a group; none makes each group one source. ``idle_batches``: a source
    without a timed row in so many batches no longer holds the watermark back (None: it always does). ``monotone``: with several
    sources the low mark never falls, so a closed period stays closed when a source returns or first appears behind it, or when all
    are idle; without it each batch has the plain smallest mark of the sources that are not idle, and none where all are.
    ``expected``: a group has no watermark before so many of its sources have shown a time.
    """

    group: str = "job_id"
    sources: tuple[str, ...] = ()
    batch: str = "batch_id"
    ts: str = "timestamp"
    delay: str = "out_of_orderness_millis"
    size: str = "window_size_millis"
    lateness: str = "allowed_lateness_millis"
    idle_batches: int | None = None
    monotone: bool = False
    expected: int = 1
    max_broadcast_rows: int = 500_000


def punctuations(rows: DataFrame, spec: LateSpec = LateSpec()) -> DataFrame:
    """(group, sources, batch, mark): the largest event time per source and batch. Rows with a null time, batch or group give none."""
    keys = [spec.group, *spec.sources, spec.batch]
    timed = rows.select(*keys, spec.ts).where(F.col(spec.ts).isNotNull() & F.col(spec.batch).isNotNull() & F.col(spec.group).isNotNull())
    return timed.groupBy(*keys).agg(F.max(F.col(spec.ts).cast("bigint")).alias("mark"))


def low_watermarks(marks: DataFrame, spec: LateSpec = LateSpec()) -> DataFrame:
    """(group, batch, mark): the low mark that holds when a batch begins; no row where no source has shown a time before.

    A source holds its group back from its first timed row on, until it is idle. The marks of one source are ordered within one
    task: that is one row per batch. Several sources of a group are spread over the batches in which their mark holds and met
    again by (group, batch), so a group with many sources isn't gathered in one task.
    """
    by_source = Window.partitionBy(spec.group, *spec.sources).orderBy(spec.batch)
    if not spec.sources:
        before = F.max("mark").over(by_source.rowsBetween(Window.unboundedPreceding, -1))
        return marks.select(spec.group, spec.batch, before.alias("mark")).where(F.col("mark").isNotNull())
    # batches that exist, numbered 0, 1, ... within their group, so that a mark holds over a stretch of those, whatever their ids
    by_group = Window.partitionBy(spec.group).orderBy(spec.batch)
    batches = marks.select(spec.group, spec.batch).distinct().withColumn("__at", F.row_number().over(by_group) - 1)
    ends = batches.groupBy(spec.group).agg(F.max("__at").alias("__last"))
    own = marks.join(batches, [spec.group, spec.batch]).join(ends, spec.group)
    until = F.coalesce(F.lead("__at").over(by_source), F.col("__last"))
    steps = own.select(spec.group, F.col(spec.batch).alias("__seen"), "__at", F.max("mark").over(by_source.rowsBetween(Window.unboundedPreceding, 0)).alias("mark"), until.alias("__until"))
    holds = steps.where(F.col("__until") > F.col("__at")).select(spec.group, "__seen", "mark", F.explode(F.sequence(F.col("__at") + 1, F.col("__until"))).alias("__at"))
    met = holds.join(batches, [spec.group, "__at"])  # a row per batch and source that was seen before it
    idle = F.lit(False) if spec.idle_batches is None else F.col(spec.batch) - F.col("__seen") > spec.idle_batches
    lows = met.groupBy(spec.group, spec.batch).agg(F.min(F.when(~idle, F.col("mark"))).alias("mark"), F.count(F.lit(1)).alias("__sources"))
    lows = lows.where(F.col("mark").isNotNull() & (F.col("__sources") >= spec.expected)).select(spec.group, spec.batch, "mark")
    if not spec.monotone:
        return lows
    carried = F.max("mark").over(by_group.rowsBetween(Window.unboundedPreceding, 0))
    every = batches.join(lows, [spec.group, spec.batch], "left")
    return every.select(spec.group, spec.batch, carried.alias("mark")).where(F.col("mark").isNotNull())


def classify(rows: DataFrame, limits: DataFrame, spec: LateSpec = LateSpec(), keep: tuple[str, ...] = ("row_id",)) -> DataFrame:
    """Every row with its period and whether it came on time, late but accepted, or too late.

    ``limits`` has one row per group with ``spec.delay``, ``spec.size`` and ``spec.lateness``.
    Returns group, batch, time, the ``keep`` columns, ``window_start``, ``window_end``, ``watermark`` and ``arrival``:
    ``on_time``; ``late`` (the period was closed, the row still corrects it); ``diverted`` (beyond the allowance); ``untimed``
    (null time, null group or a group without limits: no period). All input rows come out once each. Only the named columns are
    read; other columns, whatever their names, are left out. Empty input gives an empty result.

    The watermarks (one row per group and batch) are materialised and broadcast only after a count against
    ``spec.max_broadcast_rows``; beyond it the rows are shuffled by group and batch, and a batch that holds most rows of a group is split by AQE.
    """
    marks = cut(low_watermarks(punctuations(rows, spec), spec))
    small = marks.limit(spec.max_broadcast_rows + 1).count() <= spec.max_broadcast_rows
    named = (("delay", spec.delay), ("size", spec.size), ("late", spec.lateness))
    bounds = broadcast_within(limits.select(spec.group, *(F.col(c).cast("bigint").alias(f"__{k}") for k, c in named)), spec.max_broadcast_rows)
    cols = list(dict.fromkeys([spec.group, spec.batch, spec.ts, *keep]))
    taken = [c for c in keep if c.lower() in ("window_start", "window_end", "watermark", "arrival")]
    if taken:
        raise ValueError(f"rename before keeping: {taken}")
    known = rows.select(*cols).join(bounds, spec.group, "left")
    marks = marks.withColumnRenamed("mark", "__mark")
    if small:
        out = known.join(F.broadcast(marks), [spec.group, spec.batch], "left")
    else:  # rows without a group or batch have no mark: they needn't meet in one task
        placed = F.col(spec.group).isNotNull() & F.col(spec.batch).isNotNull()
        out = known.where(placed).join(marks, [spec.group, spec.batch], "left").unionByName(known.where(~placed).withColumn("__mark", F.lit(None).cast("bigint")))
    ts = F.col(spec.ts).cast("bigint")
    start = ts - F.pmod(ts, F.col("__size"))
    end = start + F.col("__size")
    wm = F.col("__mark") - F.col("__delay") - 1
    arrival = (
        F.when(end.isNull(), UNTIMED)
        .when(wm.isNull() | (end > wm), ON_TIME)
        .when(end + F.col("__late") > wm, LATE)
        .otherwise(DIVERTED)
    )
    return out.select(*cols, start.alias("window_start"), end.alias("window_end"), wm.alias("watermark"), arrival.alias("arrival"))


def _fold(value: str, tag: str, when: Column) -> list[Column]:
    v = F.when(when, F.col(value).cast("bigint"))
    return [*sum_parts(v, f"{tag}_sum"), F.max(v).alias(f"{tag}_max_value"), F.min(v).alias(f"{tag}_min_value"), F.count(F.when(when, 1)).alias(f"{tag}_row_count")]


def corrected_windows(classified: DataFrame, keys: tuple[str, ...] = ("job_id", "name"), value: str = "value") -> DataFrame:
    """Per key and period the aggregates as first fired (on-time rows) and as corrected (with the late rows that were accepted).

    Diverted and untimed rows count nowhere. A period known by late rows alone has first_row_count 0 and null first values; null
    values are skipped by sum, max and min but counted as rows. Sums are DECIMAL(38,0).
    """
    on_time, accepted = F.col("arrival") == ON_TIME, F.col("arrival").isin(ON_TIME, LATE)
    agg = classified.where(accepted).groupBy(*keys, "window_start", "window_end").agg(*_fold(value, "first", on_time), *_fold(value, "final", accepted))
    measures = [x for tag in ("first", "final") for x in (from_parts(f"{tag}_sum").alias(f"{tag}_sum_value"), F.col(f"{tag}_max_value"), F.col(f"{tag}_min_value"), F.col(f"{tag}_row_count"))]
    return agg.select(*keys, "window_start", "window_end", *measures)


def revisions(classified: DataFrame, keys: tuple[str, ...] = ("job_id", "name"), value: str = "value", batch: str = "batch_id") -> DataFrame:
    """The changelog of each period: revision 0 when it first fires, then one revision per batch that corrects it.

    ``batch`` is the correcting batch (null for revision 0). Rows are first combined per period and batch, so the running totals
    order at most one row per batch that falls within a period's allowance.
    """
    rev = F.when(F.col("arrival") == LATE, F.col(batch))
    part = classified.where(F.col("arrival").isin(ON_TIME, LATE)).groupBy(*keys, "window_start", "window_end", rev.alias("batch")).agg(*_fold(value, "r", F.lit(True)))
    w = Window.partitionBy(*keys, "window_start", "window_end").orderBy(F.col("batch").asc_nulls_first())
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    return part.select(
        *keys, "window_start", "window_end", "batch",
        (F.row_number().over(w) - 1 + F.when(F.max(F.col("batch").isNull()).over(run), 0).otherwise(1)).alias("revision"),
        F.sum(from_parts("r_sum")).over(run).cast("decimal(38,0)").alias("sum_value"),
        F.max("r_max_value").over(run).alias("max_value"),
        F.min("r_min_value").over(run).alias("min_value"),
        F.sum("r_row_count").over(run).alias("row_count"),
    )
