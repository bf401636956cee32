"""At-least-once delivery: accept each message exactly once with disjoint seen ranges per producer.

A message is known by its producer (one or more columns) and its number there. The seen numbers of a producer are kept as disjoint
ranges, sharded by block of numbers so that a producer with any share of the messages is spread over tasks, and a block holds at most
2^``BLOCK_BITS`` / 2 ranges. Deliveries with a malformed identifier (a null in it) are looked up by an exact key instead.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.incremental import RunStore
from tidemark.session import cut, side_by_side

#: Numbers of one block: what is ordered in one task to merge ranges.
BLOCK_BITS = 14

SEEN = "array<struct<lo:bigint,hi:bigint>>"


def combine_copies(deliveries: DataFrame, producer: tuple[str, ...], seq: str, arrival: str, copies: str | None = None) -> DataFrame:
    """(producer, seq, first, copies): map-side combined, so a message delivered any number of times costs a task one row.

    ``copies`` names the count in rows that were combined before."""
    n = F.sum(copies) if copies else F.count(F.lit(1))
    return deliveries.groupBy(*dict.fromkeys((*producer, seq))).agg(F.min(arrival).alias("first"), n.alias("copies"))


def _block(seq: str) -> Column:
    return F.shiftright(F.col(seq).cast("bigint"), BLOCK_BITS)


def place(deliveries: DataFrame, seen: DataFrame | None, producer: tuple[str, ...], seq: str) -> DataFrame:
    """``deliveries`` (producer, number, first, copies; several rows of a message are added up) and the seen ranges, in one order by number.

    Returns (producer, block, lo, hi, message, covered, island, first, copies): a message is covered if a seen range that begins by it
    reaches it; what touches or overlaps shares an island, a range of the new state. One shuffle by block and one sort do all of it.
    """
    n = F.col(seq).cast("bigint")
    rows = deliveries.select(*producer, _block(seq).alias("block"), n.alias("lo"), n.alias("hi"), F.lit(True).alias("message"), "first", "copies")
    if seen is not None:
        rows = rows.unionByName(seen.select(*producer, "block", F.inline("ranges")).withColumn("message", F.lit(False)), allowMissingColumns=True)
    by = [*producer, "block"]
    w = Window.partitionBy(*by).orderBy("lo", "message")
    told = F.max(F.when(~F.col("message"), F.col("hi"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    before = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.when((F.col("lo") <= before) | (F.col("lo") == F.try_add(before, F.lit(1))), 0).otherwise(1)
    both = rows.withColumns({"covered": F.coalesce(told >= F.col("lo"), F.lit(False)), "begins": begins})
    both = both.withColumn("island", F.sum("begins").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return both.groupBy(*by, "lo", "hi", "message", "covered", "island").agg(F.min("first").alias("first"), F.sum("copies").alias("copies"))


def ranges_of(placed: DataFrame, producer: tuple[str, ...]) -> DataFrame:
    """The seen ranges of the blocks in ``placed``: (producer, block, ranges), ranges disjoint, not adjacent, in order. Those of a block stay within it."""
    merged = placed.groupBy(*producer, "block", "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return merged.groupBy(*producer, "block").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("ranges"))


@dataclass
class Seen:
    """What is kept between runs: ranges per producer and block, and the exact keys of malformed deliveries."""

    ranges: DataFrame | None = None
    keys: DataFrame | None = None


@dataclass
class Accepted:
    """One run's result.

    ``messages``: (producer, seq, first, copies, covered); ``malformed``: (key, first, copies, covered); ``ranges``: the seen ranges after
    it. The malformed deliveries and the new ranges are computed when they are asked for.
    """

    _placed: Callable[[], DataFrame]
    producer: tuple[str, ...]
    seq: str
    _malformed: Callable[[], DataFrame]
    written: Callable[[DataFrame], DataFrame] = cut

    @cached_property
    def placed(self) -> DataFrame:
        return self._placed()

    @cached_property
    def messages(self) -> DataFrame:
        return self.placed.where("message").select(*self.producer, F.col("lo").alias(self.seq), "first", "copies", "covered")

    @cached_property
    def malformed(self) -> DataFrame:
        return self._malformed()

    @cached_property
    def ranges(self) -> DataFrame:
        """The whole state of ranges after the run."""
        return self.written(ranges_of(self.placed, self.producer))

    @property
    def arrivals(self) -> DataFrame:
        """(first): the one delivery of each message and malformed key that is let through."""
        return self.messages.where(~F.col("covered")).select("first").unionByName(self.malformed.where(~F.col("covered")).select("first"))

    @property
    def repeated(self) -> DataFrame:
        """(producer, seq): the messages that this run or an earlier one had before."""
        return self.messages.where(F.col("covered") | (F.col("copies") > 1)).select(*self.producer, self.seq)

    def seen(self, before: Seen) -> Seen:
        """The whole state after this run, to be kept for the next."""
        fresh = self.malformed.where(~F.col("covered")).select("key")
        return Seen(self.ranges, fresh if before.keys is None else before.keys.unionByName(fresh))


def accept_once(
    deliveries: DataFrame, seen: Seen, *, producer: tuple[str, ...], seq: str, arrival: str, exact_key: Column, copies: str | None = None,
    keep: Callable[[DataFrame, str], DataFrame] = lambda df, _: cut(df), written: Callable[[DataFrame], DataFrame] = cut,
) -> Accepted:
    """Take one run of deliveries: each number that no seen range covers is accepted once, as its first arrival; then ranges merge.

    ``exact_key`` identifies a delivery whose producer or number is null; equal keys are copies. Rows need ``arrival``, a unique,
    orderable id. Rows that were combined before name their column ``copies``; others are combined map-side. Empty input accepts nothing
    and leaves the state. ``keep`` writes messages and malformed deliveries, ``written`` the new
    ranges: by default to the checkpoint folder, so a lost executor costs a re-read, and so the lineage doesn't grow with the number of runs.
    """
    broken = reduce(lambda a, b: a | b, (F.col(c).isNull() for c in (*producer, seq)))
    counts = [copies] if copies else []
    good = deliveries.where(~broken).select(*producer, F.col(seq).cast("bigint").alias(seq), arrival, *counts)
    if copies:
        good = good.withColumnsRenamed({arrival: "first", copies: "copies"})
    else:
        good = combine_copies(good, producer, seq, arrival)
    placed = lambda: keep(place(good, seen.ranges, producer, seq), "messages")

    def malformed() -> DataFrame:
        odd = combine_copies(deliveries.where(broken).select(exact_key.alias("key"), arrival, *counts), ("key",), "key", arrival, copies)
        known = seen.keys.select("key").withColumn("covered", F.lit(True)) if seen.keys is not None else None
        judged = odd.withColumn("covered", F.lit(False)) if known is None else odd.join(known, "key", "left").withColumn("covered", F.coalesce("covered", F.lit(False)))
        return keep(judged, "malformed")

    return Accepted(placed, producer, seq, malformed, written)


def run_deliveries(store: RunStore, deliveries: DataFrame, *, producer: tuple[str, ...], seq: str, arrival: str, exact_key: Column, copies: str | None = None, tag: int | None = None) -> Accepted:
    """One run whose messages, malformed deliveries, seen ranges and exact keys are committed together: a run that fails leaves nothing,
    so repeated it neither skips nor repeats. ``deliveries`` is read several times: give a written table.

    Ranges and keys lie in buckets by hash. The run reads and writes those of the blocks and keys that its deliveries meet.
    """
    commit, draft = store.last(), store.draft()
    broken = reduce(lambda a, b: a | b, (F.col(c).isNull() for c in (*producer, seq)))
    bucket = lambda *cols: F.shiftrightunsigned(F.xxhash64(*cols), 64 - store.bucket_bits).cast("int")
    met = deliveries.select(F.when(~broken, bucket(*producer, _block(seq))).alias("r"), F.when(broken, bucket(exact_key)).alias("k")).distinct().collect()  # at most 512
    ranges, keys = (sorted({m[c] for m in met if m[c] is not None}) for c in ("r", "k"))
    seen = Seen(store.state("ranges", ranges, commit), store.state("keys", keys, commit))
    run = accept_once(deliveries, seen, producer=producer, seq=seq, arrival=arrival, exact_key=exact_key, copies=copies, keep=draft.keep, written=lambda df: df)

    def numbered() -> None:
        draft.keep_buckets(run.ranges.withColumn("bucket", bucket(*producer, "block")), "ranges", ranges)

    def keyed() -> None:
        fresh = run.malformed.where(~F.col("covered")).select("key")
        all_keys = fresh if seen.keys is None else fresh.unionByName(seen.keys.select("key"))
        draft.keep_buckets(all_keys.withColumn("bucket", bucket("key")), "keys", keys)

    side_by_side(numbered, keyed)
    store.publish_parts({}, {}, tag=tag, draft=draft)
    return run


def runs_of(deliveries: DataFrame, batch: str, runs: int) -> list[Column]:
    """Conditions that cut the batches into ``runs`` consecutive runs, equally long in batch ids; every row meets exactly one."""
    lo, hi = deliveries.agg(F.min(batch), F.max(batch)).first()
    if lo is None:
        return [F.lit(True)]
    edges = sorted({lo + (hi + 1 - lo) * i // runs for i in range(1, runs)})
    b, out = F.col(batch), []
    for i in range(len(edges) + 1):
        c = F.lit(True) if not i else b >= edges[i - 1]
        c = c & (b < edges[i]) if i < len(edges) else c
        out.append(c | b.isNull() if not i else c)
    return out
