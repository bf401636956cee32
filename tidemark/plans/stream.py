"""The fluent facade: Stream -> Keyed -> Windowed -> Stream around a DataFrame, bounded or streaming.

It only declares: each call adds to the logical plan, and Catalyst chooses how to run it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.functions.aggregates import Agg
from tidemark.functions.histogram import bucket, bucket_small
from tidemark.functions.windows import Hop
from tidemark.session import broadcast_within
from tidemark.streaming.state import CoProcess, co_process, fold_windows, strict
from tidemark.streaming.watermarks import Strategy
from tidemark.types import locate

#: Windows per row from which panes are shared by default.
SHARE_FROM = 4
#: Windows that are combined from panes in one place span this many window sizes.
BLOCK_SIZES = 8


class Stream:
    """Rows with an optional event time, ``ts``: a LONG column of epoch milliseconds."""

    def __init__(self, df: DataFrame, ts: str | None = None, strategy: Strategy | None = None):
        self.df, self.ts, self.strategy = df, ts, strategy

    def _with(self, df: DataFrame) -> Stream:
        return Stream(df, self.ts if self.ts in df.columns else None, self.strategy)

    # rows

    def map(self, *cols: Column | str) -> Stream:
        return self._with(self.df.select(*cols))

    def filter(self, condition: Column | str) -> Stream:
        return self._with(self.df.where(condition))

    def filter_windows(self, begin: int = 0, end: int | None = None) -> Stream:
        """Keep windows with start >= begin and end <= end. Rows without window columns pass."""
        if "window_start" not in self.df.columns:
            return self
        keep = F.col("window_start") >= begin
        return self._with(self.df.where(keep if end is None else keep & (F.col("window_end") <= end)))

    def flat_map(self, rows: Column, *keep: str) -> Stream:
        """One row per element of the array ``rows``; struct elements become columns, others ``value``. Null and empty arrays give none."""
        out = self.df.select(*keep, F.explode(rows).alias("value"))
        if isinstance(out.schema["value"].dataType, T.StructType):
            out = out.select(*keep, "value.*")
        return self._with(out)

    def flat_map_batches(self, fn: Callable[[Iterator[Any]], Iterator[Any]], schema: T.StructType | str) -> Stream:
        """Rows computed in Python, in Arrow batches of pandas frames: for what columns can't express."""
        return self._with(self.df.mapInPandas(fn, schema))

    # time and keys

    def assign_timestamps(self, strategy: Strategy, source: Sequence[str] = (), order: Sequence[str] = (), clock: str | None = None, tick: str | None = None) -> Stream:
        """Set the event time; rows with a null time have no event time and are left out, as no window can hold them.

        With ``source`` columns the strategy's own watermark is kept per source, row by row, and rows below it are dropped:
        see :func:`tidemark.streaming.state.strict`, also for ``order``, ``clock`` and ``tick``.
        """
        if not source:
            return Stream(strategy.assign(self.df), strategy.column, strategy)
        kept = strict(self.df, strategy, source, order, clock, tick).where(~F.col("late")).drop("late", "watermark")
        return Stream(strategy.watermarked(kept) if kept.isStreaming else kept, strategy.column, strategy)

    def key_by(self, *columns: int | str, **computed: Column) -> Keyed:
        """Key columns by name or index, or computed: ``key_by("name", parity=F.col("value") % 2)``; at least one."""
        if not columns and not computed:
            raise ValueError("a key needs columns")
        taken = sorted(set(computed) & set(self.df.columns))
        if taken:
            raise ValueError(f"columns of these names exist: {taken}")
        named = [self.df.columns[locate(self.df.schema, c)] for c in columns]
        return Keyed(self._with(self.df.withColumns(computed)) if computed else self, [*named, *computed])

    # several streams

    def union(self, *others: Stream) -> Stream:
        """All rows of streams with the same columns."""
        df = self.df
        for o in others:
            df = df.unionByName(o.df)
        return self._with(df)

    def connect(self, *others: Stream | Keyed) -> Connected:
        return Connected(self, [o.stream if isinstance(o, Keyed) else o for o in others])

    def enrich(self, config: Stream, on: str | list[str], max_rows: int = 1_000_000) -> Stream:
        """Left rows with the config rows of their key; broadcast after a count, beyond ``max_rows`` shuffled."""
        return self._with(self.df.join(broadcast_within(config.df, max_rows), on, "left"))

    # partitioning

    def round_robin(self, n: int) -> Stream:
        """Deal the rows evenly over ``n`` partitions."""
        return self._with(self.df.repartition(n))

    def replicate(self, n: int, channel: str = "channel") -> Stream:
        """Each row once for each of ``n`` channels."""
        return self._with(self.df.withColumn(channel, F.explode(F.sequence(F.lit(0), F.lit(n - 1)))))

    def observed(self, name: str, *more: Column) -> Stream:
        """Count the rows that pass, and further aggregates: read them with :class:`tidemark.streaming.metrics.Meters`."""
        return self._with(self.df.observe(name, F.count(F.lit(1)).alias("rows"), *more))

    def sink(self, to: Callable[[DataFrame], Any]) -> Any:
        """Hand the rows to a sink of :mod:`tidemark.sources.sinks`."""
        return to(self.df)


class Connected:
    """Several streams met by one process: left rows are those of the first stream, right ones come with their sequence number."""

    def __init__(self, left: Stream, rights: list[Stream]):
        self.left, self.rights = left, rights

    def process(self, left: Callable[[DataFrame], DataFrame] | None, right: Callable[[int, DataFrame], DataFrame | None] | None = None) -> Stream:
        """The union of what the functions make of each input, by column name; missing columns are null. None drops an input."""
        parts = [left(self.left.df)] if left else []
        parts += [p for i, r in enumerate(self.rights) if right and (p := right(i, r.df)) is not None]
        if not parts:
            raise ValueError("every input is dropped")
        df = parts[0]
        for p in parts[1:]:
            df = df.unionByName(p, allowMissingColumns=True)
        return self.left._with(df)

    def stateful(self, keys: Sequence[str], process: Callable[[], CoProcess], schema: T.StructType | str, order: Sequence[str] = ()) -> Stream:
        """Rows of all inputs, met by key in one stateful process: see :class:`tidemark.streaming.state.CoProcess`."""
        return self.left._with(co_process([self.left.df, *(r.df for r in self.rights)], list(keys), process, schema, list(order)))


class Keyed:
    def __init__(self, stream: Stream, keys: list[str]):
        self.stream, self.keys = stream, keys

    def window(self, windows: Hop | Callable[[Column], Column]) -> Windowed:
        """Windows by a :class:`Hop`, or by a function from the time to array<struct<start, end>>."""
        if self.stream.ts is None:
            raise ValueError("windows need an event time: assign_timestamps first")
        return Windowed(self.stream, self.keys, windows)

    def partition(self, n: int | None = None) -> Stream:
        cols = [F.col(k) for k in self.keys]
        return self.stream._with(self.stream.df.repartition(n, *cols) if n else self.stream.df.repartition(*cols))


class Windowed:
    def __init__(self, stream: Stream, keys: list[str], windows: Hop | Callable[[Column], Column]):
        self.stream, self.keys, self.windows = stream, keys, windows

    def assigned(self) -> DataFrame:
        """The rows with window_start and window_end, one for each window that holds them."""
        w, ts = self.windows, F.col(self.stream.ts)
        if isinstance(w, Hop):
            start = w.last_start(ts) if w.candidates == 1 else F.explode(w.starts(ts))
            kept = self.stream.df.withColumn("window_start", start).where(w.holds(F.col("window_start"), ts))
            return kept.withColumn("window_end", F.col("window_start") + w.size)
        spread = self.stream.df.withColumn("__w", F.explode(w(ts)))
        return spread.withColumns({"window_start": F.col("__w.start"), "window_end": F.col("__w.end")}).drop("__w")

    def reduce(self, *aggs: Agg, share_panes: bool | None = None) -> Stream:
        """One row per key and window: key columns, aggregates, window_start and window_end.

        Bounded input with hopping windows can first be combined into panes of one slide and these into windows (``share_panes``;
        by default from ``SHARE_FROM`` windows a row on), so that a row is read once, not once per window.
        """
        if not aggs:
            raise ValueError("nothing to aggregate")
        for a in aggs:
            a.check(self.stream.df.schema)
        return self._streaming(aggs) if self.stream.df.isStreaming else self._bounded(aggs, share_panes)

    def _bounded(self, aggs: Sequence[Agg], share: bool | None) -> Stream:
        w, keys, schema = self.windows, self.keys, self.stream.df.schema
        panes = isinstance(w, Hop) and w.shared > 1 and (share if share is not None else w.shared >= SHARE_FROM)
        plain = [(i, a) for i, a in enumerate(aggs) if a.kind != "pct"]
        hists = [(i, a) for i, a in enumerate(aggs) if a.kind == "pct"]
        if panes:
            pane = w.last_start(F.col(self.stream.ts))
            rows, at = self.stream.df.withColumn("window_start", pane), ["window_start"]
        else:
            rows, at = self.assigned(), ["window_start", "window_end"]
        if hists:  # one row per histogram, the plain aggregates ride on the first
            each = [F.struct(F.lit(j).alias("tag"), (bucket if len(a.scale) <= 128 else bucket_small)(F.col(f"`{a.column}`"), a.scale).alias("bucket")) for j, (_, a) in enumerate(hists)]
            rows = rows.withColumn("__h", F.explode(F.array(*each)) if len(each) > 1 else each[0]).withColumns({"__tag": F.col("__h.tag"), "__bucket": F.col("__h.bucket")})
            at = [*at, "__tag", "__bucket"]
        parts = [a.partial().alias(f"__a{i}") for i, a in plain] + ([F.count(F.lit(1)).alias("__n")] if hists else [])
        out = rows.groupBy(*keys, *at).agg(*parts)
        again = [a.combine(F.col(f"__a{i}")).alias(f"__a{i}") for i, a in plain]
        if panes:  # panes, not their copies, are shuffled: by key and stretch of time, within which windows are combined in place
            last, stretch = F.col("window_start"), F.lit(w.size * BLOCK_SIZES).cast("bigint")
            of = lambda s: F.floor(s / stretch).cast("bigint")
            first = last - (w.size - w.slide)
            own = F.when(of(first) == of(last), F.array(of(last))).otherwise(F.array(of(first), of(last)))
            placed = out.withColumn("__block", F.explode(own)).repartition(*keys, "__block")
            out = placed.withColumn("window_start", F.explode(w.starts(last))).where((last >= 0) & (of(last) == F.col("__block")))
            out = out.groupBy(*keys, "__block", *at).agg(*again, *([F.sum("__n").alias("__n")] if hists else [])).drop("__block").withColumn("window_end", last + w.size)
        if hists:
            first = [a.combine(F.when(F.col("__tag") == 0, F.col(f"__a{i}"))).alias(f"__a{i}") for i, a in plain]
            maps = [F.map_from_entries(F.collect_list(F.when((F.col("__tag") == j) & F.col("__bucket").isNotNull(), F.struct("__bucket", "__n")))).alias(f"__a{i}") for j, (i, _) in enumerate(hists)]
            out = out.groupBy(*keys, "window_start", "window_end").agg(*first, *maps)
        results = [a.result(F.col(f"__a{i}"), schema).alias(a.output) for i, a in enumerate(aggs)]
        return Stream(out.select(*keys, *results, "window_start", "window_end"), None, None)

    def _streaming(self, aggs: Sequence[Agg]) -> Stream:
        if not isinstance(self.windows, Hop):
            return self._folding(aggs)
        w, strategy, schema = self.windows, self.stream.strategy, self.stream.df.schema
        rows = self.stream.df
        if w.slide > w.size:  # by the watermarked column, as else the filter goes below it and rows in gaps don't move the watermark
            ts = F.unix_millis(strategy.event_time)
            rows = rows.where(ts < w.last_start(ts) + w.size)
        exprs = []
        for a in aggs:
            if a.kind == "pct":
                b = bucket(F.col(f"`{a.column}`"), a.scale)
                counts = F.array(*(F.count(F.when(b == j, 1)) for j in range(len(a.scale))))
                pairs = F.transform(counts, lambda n, j: F.struct(j.alias("bucket"), n.alias("n")))
                exprs.append(F.map_from_entries(F.filter(pairs, lambda x: x["n"] > 0)).alias(a.output))
            else:
                exprs.append(a.result(a.partial(), schema).alias(a.output))
        grouped = rows.groupBy(w.column(F.col(strategy.event_time)).alias("window"), *self.keys).agg(*exprs)
        start = F.unix_millis("window.start")
        end = start + w.size
        out = grouped.where(start >= 0).select(*self.keys, *(F.col(f"`{a.output}`") for a in aggs), start.alias("window_start"), end.alias("window_end"))
        return Stream(out, None, None)

    def fold(self, step: Callable[[dict | None, dict], dict], merge: Callable[[dict, dict], dict], schema: T.StructType | str) -> Stream:
        """A custom aggregate per key and window: ``step(acc or None, row) -> acc``, ``merge(acc, acc) -> acc``; acc is a dict of ``schema``.

        Rows are folded where they are read, so only one accumulator per task, key and window is shuffled; ``merge`` must be
        associative and commutative. A task holds at most 100,000 accumulators before it passes them on. Values keep their types:
        integers come as int, nulls as None. On a stream each accumulator is keyed state, given out when the watermark passes its window.
        """
        acc = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
        if self.stream.df.isStreaming:
            return Stream(fold_windows(self.assigned(), self.keys, step, acc), None, None)
        df, by = self.assigned(), [*self.keys, "window_start", "window_end"]
        full = T.StructType([*(df.schema[k] for k in by), *acc.fields])
        names = acc.names

        arrow = to_arrow_schema(full)

        def batch(rows: list[dict]) -> Any:
            import pyarrow as pa

            return pa.RecordBatch.from_pylist(rows, schema=arrow)

        def fold_rows(batches: Iterator[Any]) -> Iterator[Any]:
            held: dict[tuple, dict] = {}
            out = lambda: batch([dict(zip(by, k)) | {n: v[n] for n in names} for k, v in held.items()])
            for b in batches:
                for row in b.to_pylist():
                    k = tuple(row[c] for c in by)
                    held[k] = step(held.get(k), row)
                if len(held) >= 100_000:
                    yield out()
                    held = {}
            if held:
                yield out()

        def merge_sorted(batches: Iterator[Any]) -> Iterator[Any]:
            at: tuple | None = None
            have: dict = {}
            done: list[dict] = []
            for b in batches:
                for row in b.to_pylist():
                    k = tuple(row[c] for c in by)
                    if k == at:
                        have = merge(have, row)
                        continue
                    if at is not None:
                        done.append(dict(zip(by, at)) | {n: have[n] for n in names})
                    at, have = k, row
                if done:
                    yield batch(done)
                    done = []
            if at is not None:
                yield batch([dict(zip(by, at)) | {n: have[n] for n in names}])

        parts = df.mapInArrow(fold_rows, full)
        merged = parts.repartition(*by).sortWithinPartitions(*by).mapInArrow(merge_sorted, full)
        return Stream(merged, None, None)

    def _folding(self, aggs: Sequence[Agg]) -> Stream:
        """Windows of a custom assigner on a stream: the aggregates as one keyed accumulator per window."""
        pct = [a.output for a in aggs if a.kind == "pct"]
        if pct:
            raise ValueError(f"percentiles need hopping or tumbling windows on a stream: {pct}")
        schema = self.stream.df.schema
        fields = T.StructType([T.StructField(a.output, a.type(schema)) for a in aggs])
        plan = [(a.output, a.kind, a.column) for a in aggs]

        def step(acc: dict | None, row: dict) -> dict:
            acc = acc or {name: 0 if kind == "count" else None for name, kind, _ in plan}
            for name, kind, column in plan:
                v, old = 1 if kind == "count" else row[column], acc[name]
                if v is not None:
                    acc[name] = v if old is None else old + v if kind in ("count", "sum") else max(old, v) if kind == "max" else min(old, v)
            return acc

        return Stream(fold_windows(self.assigned(), self.keys, step, fields), None, None)
