"""Integer sums that cannot overflow, with fixed-width partial states."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_LOW = 0xFFFFFFFF


def sum_parts(value: Column, name: str) -> list[Column]:
    """Two BIGINT aggregates, the high and the low 32 bits of a LONG: algebraic, map-side combinable, safe for 2^31 rows a group and more."""
    v = value.cast("bigint")
    return [F.sum(F.shiftright(v, 32)).alias(f"{name}__hi"), F.sum(v.bitwiseAND(F.lit(_LOW))).alias(f"{name}__lo")]


def from_parts(name: str) -> Column:
    """The exact sum as DECIMAL(38,0); null where all values were null."""
    return (F.col(f"{name}__hi").cast("decimal(38,0)") * F.lit(_LOW + 1).cast("decimal(38,0)") + F.col(f"{name}__lo").cast("decimal(38,0)")).cast("decimal(38,0)")
