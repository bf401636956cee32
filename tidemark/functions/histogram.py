"""Percentiles from histograms over a fixed scale of bucket bounds: mergeable counts, one pass, no sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bucket bounds of the 90-point scale.
SCALE_90 = (
    1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 14, 16, 18, 20, 25, 30, 35, 40, 45, 50, 60, 70, 80, 90, 100, 120, 140, 160, 180, 200, 250, 300, 350, 400, 450, 500, 600, 700, 800,
    900, 1000, 1200, 1400, 1600, 1800, 2000, 2500, 3000, 3500, 4000, 4500, 5000, 6000, 7000, 8000, 9000, 10000, 12000, 14000, 16000, 18000, 20000, 25000, 30000, 35000,
    40000, 45000, 50000, 60000, 70000, 80000, 90000, 100000, 120000, 140000, 160000, 180000, 200000, 250000, 300000, 350000, 400000, 450000, 500000, 600000, 700000, 800000, 900000, 1000000,
)


def stepped(*spans: tuple[int, int, int]) -> tuple[int, ...]:
    """A scale from (first, last, step) spans, ends included."""
    return tuple(x for first, last, step in spans for x in range(first, last + 1, step))


# Spans of the 345-point and the 2400-point scale.
SCALE_345 = stepped((1, 50, 1), (52, 100, 2), (110, 1000, 10), (1100, 10_000, 100), (11_000, 100_000, 1000))
SCALE_2400 = stepped((1, 1000, 1), (1010, 10_000, 10), (10_100, 60_000, 100))

#: What a read-out gives for a histogram without counts.
NOTHING = 1.7976931348623157e308


def check(scale: Sequence[float]) -> list[float]:
    """The scale as a list; raises unless it is non-empty and strictly ascending."""
    out = [float(x) for x in scale]
    if not out or any(a >= b for a, b in zip(out, out[1:])):
        raise ValueError("a scale needs ascending bounds")
    return out


def bucket(value: Column, scale: Sequence[float]) -> Column:
    """The 0-based bucket: the first bound that is not below the value, the last bucket beyond all; null for a null value.

    NaN is beyond all bounds. The search is a balanced tree of comparisons, so it stays within generated code.
    """
    bounds, v = check(scale), value.cast("double")

    def search(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(v <= bounds[mid], search(lo, mid)).otherwise(search(mid + 1, hi))

    return F.when(v.isNotNull(), search(0, len(bounds) - 1))


def bucket_small(value: Column, scale: Sequence[float]) -> Column:
    """The same by an array filter: shorter plans for scales of many hundred bounds."""
    bounds = F.array(*map(F.lit, check(scale)))
    v = value.cast("double")
    return F.when(v.isNotNull(), F.least(F.size(F.filter(bounds, lambda b: b < v)), F.lit(len(scale) - 1)))


def merge(a: Column, b: Column) -> Column:
    """Counts of two histograms over one scale, bucket by bucket."""
    return F.zip_with(a, b, lambda x, y: x + y)


def percentile(pairs: Column, total: Column, scale: Sequence[float], p: int) -> Column:
    """Read a percentile from the occupied buckets ``pairs``, array<struct<bucket, n>> sorted by bucket.

    Counts from the top until at least clamp(trunc(total * (100 - p) / 100), 1, total) values are passed; gives that bucket's bound.
    """
    if not 0 <= p <= 100:
        raise ValueError("a percentile lies between 0 and 100")
    bounds = F.array(*map(F.lit, check(scale)))
    pos = F.greatest(F.lit(1).cast("bigint"), F.least(total, F.floor(total.cast("double") * F.lit((100 - p) / 100)).cast("bigint")))
    start = F.struct(F.lit(0).cast("bigint").alias("seen"), F.lit(None).cast("int").alias("at"))

    def step(acc: Column, x: Column) -> Column:
        seen = acc["seen"] + x["n"]
        return F.struct(seen.alias("seen"), F.when(acc["at"].isNotNull(), acc["at"]).when(seen >= pos, x["bucket"]).alias("at"))

    at = F.aggregate(F.reverse(pairs), start, step)["at"]
    return F.coalesce(F.get(bounds, at), F.lit(NOTHING))


def encode(counts: Sequence[int]) -> bytes:
    """The binary form of a state: the counts and their total as big-endian 64-bit numbers."""
    return b"".join(int(x).to_bytes(8, "big") for x in (*counts, sum(counts)))


def decode(state: bytes) -> list[int]:
    if len(state) % 8 or len(state) < 16:
        raise ValueError("not a histogram state")
    return [int.from_bytes(state[i : i + 8], "big") for i in range(0, len(state) - 8, 8)]
