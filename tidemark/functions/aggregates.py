"""Aggregates of a window: count, sum, max, min and histogram percentiles, named as ``sum(value)`` and the like."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import histogram
from tidemark.types import is_numeric


@dataclass(frozen=True)
class Agg:
    """One aggregate. All but pct are algebraic: ``partial`` over rows, ``combine`` over partials, so panes of windows can share work."""

    kind: str
    column: str | None = None
    name: str = ""
    scale: tuple[float, ...] = field(default=(), repr=False)
    same_type: bool = False

    @property
    def output(self) -> str:
        return self.name or ("count" if self.kind == "count" else f"{self.kind}({self.column})")

    def named(self, name: str) -> Agg:
        return Agg(self.kind, self.column, name, self.scale, self.same_type)

    def check(self, schema: T.StructType) -> None:
        if self.column is not None:
            kind = schema[self.column].dataType
            if not is_numeric(kind):
                raise TypeError(f"{self.output}: {kind.simpleString()} can't be aggregated")

    def type(self, schema: T.StructType) -> T.DataType:
        """The result's type: that of the column, sums widened unless ``same_type``; counts are LONG."""
        if self.kind == "count":
            return T.LongType()
        kind = schema[self.column].dataType
        if self.kind != "sum" or self.same_type:
            return kind
        if isinstance(kind, T.IntegralType):
            return T.LongType()
        return T.DecimalType(min(38, kind.precision + 10), kind.scale) if isinstance(kind, T.DecimalType) else T.DoubleType()

    def partial(self) -> Column:
        if self.kind == "count":
            return F.count(F.lit(1))
        return {"sum": F.sum, "max": F.max, "min": F.min}[self.kind](F.col(f"`{self.column}`"))

    def combine(self, partial: Column) -> Column:
        return {"count": F.sum, "sum": F.sum, "max": F.max, "min": F.min}[self.kind](partial)

    def result(self, value: Column, schema: T.StructType) -> Column:
        return value.cast(schema[self.column].dataType) if self.same_type and self.column else value


def count() -> Agg:
    """COUNT(*)."""
    return Agg("count")


def sum_(column: str, same_type: bool = False) -> Agg:
    """SUM: widened as Spark does (integers to LONG; overflow is an error), or cast back to the input type. Nulls are skipped."""
    return Agg("sum", column, same_type=same_type)


def max_(column: str) -> Agg:
    """MAX. NaN is the largest value."""
    return Agg("max", column)


def min_(column: str) -> Agg:
    return Agg("min", column)


def pct(column: str, scale: Sequence[float]) -> Agg:
    """Histogram of the column over ``scale``; the result is map<bucket, n> of the occupied buckets, read by :func:`pct_value`."""
    return Agg("pct", column, scale=tuple(histogram.check(scale)))


def pct_value(hist: Column, scale: Sequence[float], p: int) -> Column:
    """A percentile from the result of :func:`pct`."""
    pairs = F.sort_array(F.transform(F.map_entries(hist), lambda e: F.struct(e["key"].alias("bucket"), e["value"].alias("n"))))
    total = F.aggregate(pairs, F.lit(0).cast("bigint"), lambda acc, x: acc + x["n"])
    return histogram.percentile(pairs, total, scale, p)
