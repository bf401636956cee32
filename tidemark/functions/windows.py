"""Event-time windows over epoch milliseconds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Hop:
    """Windows [s, s + size) for each s aligned to ``slide`` from ``offset``, in milliseconds; those that begin before the epoch are left out.

    ``slide`` above ``size`` leaves gaps: rows there are in no window.
    """

    size: int
    slide: int
    offset: int = 0

    def __post_init__(self) -> None:
        if self.size <= 0 or self.slide <= 0 or abs(self.offset) >= self.slide:
            raise ValueError("a window needs size > 0, slide > 0 and |offset| < slide")

    @property
    def shared(self) -> int:
        """Windows that a pane of ``slide`` belongs to, if panes can be shared; else 0."""
        return self.size // self.slide if self.size % self.slide == 0 else 0

    def last_start(self, ts: Column) -> Column:
        """The latest window start at or before ``ts``."""
        return ts - F.pmod(ts - F.lit(self.offset), F.lit(self.slide).cast("bigint"))

    @property
    def candidates(self) -> int:
        """The most windows that can hold one time."""
        return -(-self.size // self.slide)

    def column(self, ts: Column) -> Column:
        """Spark's own window column, for streams: ``ts`` is a TIMESTAMP. With gaps it is the whole slide; the rows of a gap are filtered out before."""
        ms = lambda n: f"{n} milliseconds"
        return F.window(ts, ms(max(self.size, self.slide)), ms(self.slide), ms(self.offset))

    def starts(self, ts: Column) -> Column:
        """The starts of the ``candidates`` latest windows that begin by ``ts``, as array<bigint>, earliest first: to be exploded and
        kept where :meth:`holds`. No lambda, so that both steps stay within generated code."""
        last = self.last_start(ts)
        return F.array(*(last - F.lit(k * self.slide) for k in range(self.candidates - 1, -1, -1)))

    def holds(self, start: Column, ts: Column) -> Column:
        """Whether the window that begins at ``start``, one of :meth:`starts`, counts and holds ``ts``."""
        keep = start >= 0
        return keep if self.shared else keep & (start + self.size > ts)


def hop(size: int, slide: int, offset: int = 0) -> Hop:
    return Hop(size, slide, offset)


def tumble(size: int, offset: int = 0) -> Hop:
    return Hop(size, size, offset)


def window_start(ts: Column, offset: int, size: int) -> Column:
    """The start of the ``size`` window that holds ``ts``: ts - (ts - offset + size) mod size."""
    return ts - F.pmod(ts - F.lit(offset), F.lit(size).cast("bigint"))


def intersects(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Whether two windows meet, ends included."""
    return (a_start <= b_end) & (b_start <= a_end)


def cover(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> tuple[Column, Column]:
    """The smallest window over two."""
    return F.least(a_start, b_start), F.greatest(a_end, b_end)
