"""Percentiles per group by dyadic Count-sketches that add up across partitions, batches and days.

A value is encoded as an order-preserving code of ``12 + mantissa_bits`` bits: the leading bits of its double. Integers below
2^(mantissa_bits + 1) are exact, others are cut towards zero by less than 2^-mantissa_bits of their size. Over the codes stands one
signed Count-sketch (``depth`` rows of ``width`` counters) per binary resolution: level j counts the nodes code >> j. The resolution
with 2^``top_bits`` nodes is counted exactly, and coarser ones follow from it. A rank is inverted by descending: take the node of the
exact level that holds it, then at each finer level go left or right by the estimated counts of the two children.

A state is a vector of (cell, count) entries. While a group shows at most ``sparse_limit`` distinct codes its cells are the codes
themselves, which is exact; beyond that they are the sketch's counters, of which there are a fixed number. Both are linear: states of
one kind merge by adding equal cells, codes turn into counters at any time, and a deletion is an entry of weight -1.

``sparse_limit`` is the caller's choice: 0 sketches every group, a large one is exact where that takes no more room than counters. The
result says of each group which it got (``exact``). Stated error: of exact groups none but the code's; of sketched groups the rank of a
returned value is off by at most ``Sketch.rank_error`` of the group's rows with probability 0.99, for groups of 256 codes and more
(in smaller ones single rows are a larger share than that, so keep those exact).
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows or entries that a task holds before it folds them.
FLUSH = 1 << 20


def _mix(x: np.ndarray) -> np.ndarray:
    """A fixed 64-bit finaliser (multiply, xor-shift), the same in every process."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass(frozen=True)
class Sketch:
    """Parameters; states are mergeable only under equal ones. ``width`` is a power of two, ``depth`` odd."""

    mantissa_bits: int = 20
    top_bits: int = 11
    width: int = 512
    depth: int = 7
    sparse_limit: int = 32768  # about where the counters become fewer than the codes
    seed: int = 1

    @property
    def levels(self) -> int:
        return 12 + self.mantissa_bits - self.top_bits

    @property
    def cells(self) -> int:
        return self.levels * self.depth * self.width + (1 << self.top_bits)

    @property
    def rank_error(self) -> float:
        return 5 / self.width

    # -- codes

    def encode(self, values: np.ndarray) -> np.ndarray:
        bits = (values.astype(np.float64) + 0.0).view(np.uint64)  # -0.0 becomes 0.0
        ordered = np.where(bits >> np.uint64(63) == 1, ~bits, bits | np.uint64(1 << 63))
        return (ordered >> np.uint64(52 - self.mantissa_bits)).astype(np.int64)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        shift = 52 - self.mantissa_bits
        ordered = codes.astype(np.uint64) << np.uint64(shift)
        negative = ordered >> np.uint64(63) == 0
        return np.where(negative, ~(ordered | np.uint64((1 << shift) - 1)), ordered & np.uint64((1 << 63) - 1)).view(np.float64)

    # -- counters

    def _places(self, level: int, nodes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each row of a level: the nodes' cells and signs."""
        for r in range(self.depth):
            salt = _mix(np.array([(self.seed << 32) + level * 64 + r + 1], dtype=np.uint64))[0]
            h = _mix(nodes.astype(np.uint64) ^ salt)
            yield (level * self.depth + r) * self.width + (h & np.uint64(self.width - 1)).astype(np.int64), 1 - 2 * (h >> np.uint64(63)).astype(np.int64)

    def add(self, counters: np.ndarray, codes: np.ndarray, weights: np.ndarray) -> None:
        for level in range(self.levels):
            for at, sign in self._places(level, codes >> level):
                np.add.at(counters, at, sign * weights)
        np.add.at(counters, self.levels * self.depth * self.width + (codes >> self.levels), weights)

    def _estimate(self, counters: np.ndarray, level: int, nodes: np.ndarray) -> np.ndarray:
        return np.median(np.stack([sign * counters[at] for at, sign in self._places(level, nodes)]), axis=0)

    def invert(self, counters: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """The codes at the given ranks (1 is the smallest value)."""
        top = np.cumsum(np.maximum(counters[self.levels * self.depth * self.width :], 0))
        node = np.minimum(np.searchsorted(top, targets), len(top) - 1)
        below = np.where(node > 0, top[node - 1], 0)
        rest, mass = (targets - below).astype(float), (top[node] - below).astype(float)
        for level in range(self.levels - 1, -1, -1):
            pair = np.stack([2 * node, 2 * node + 1])
            left, right = self._estimate(counters, level, pair.ravel()).reshape(pair.shape)
            left = np.clip((left + mass - right) / 2, 0, mass)  # the two children share what their parent has
            go_right = rest > left
            node = 2 * node + go_right
            rest, mass = np.where(go_right, rest - left, rest), np.where(go_right, mass - left, left)
        return node


# -- folding entries of many groups ----------------------------------------------------------------------------------------------


def _groups(keys: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """A group number per row, and one row of each group."""
    gid = np.zeros(keys.num_rows, dtype=np.int64)
    for col in keys.columns:
        enc = col.combine_chunks()
        enc = (enc.combine_chunks() if isinstance(enc, pa.ChunkedArray) else enc).dictionary_encode(null_encoding="encode")
        gid = np.unique(gid * max(1, len(enc.dictionary)) + enc.indices.to_numpy(zero_copy_only=False), return_inverse=True)[1]
    first = np.unique(gid, return_index=True)[1]
    return gid, first


def _fold(sk: Sketch, gid: np.ndarray, n_groups: int, dense: np.ndarray, cells: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Add equal cells. ``dense`` tells the kind of each entry. Returns, sorted by group: offsets per group, kinds per group, cells, counts."""
    order = np.lexsort((cells, dense, gid))
    g, d, c, w = gid[order], dense[order], cells[order], counts[order]
    begins = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (d[1:] != d[:-1]) | (c[1:] != c[:-1])])) if len(g) else np.zeros(0, dtype=np.int64)
    w = np.add.reduceat(w, begins) if len(g) else w
    g, d, c = g[begins], d[begins], c[begins]
    keep = w != 0
    g, d, c, w = g[keep], d[keep], c[keep], w[keep]
    kinds = np.bincount(g[d], minlength=n_groups) > 0
    kinds |= np.bincount(g, minlength=n_groups) > sk.sparse_limit
    kinds[np.setdiff1d(gid[dense], g)] = True  # counters that all came to zero
    if kinds.any():
        parts = [(g[~kinds[g]], c[~kinds[g]], w[~kinds[g]])]
        edges = np.searchsorted(g, np.arange(n_groups + 1))
        for k in np.flatnonzero(kinds):
            own = slice(edges[k], edges[k + 1])
            counters = np.zeros(sk.cells, dtype=np.int64)
            is_dense = d[own]
            counters[c[own][is_dense]] = w[own][is_dense]
            if (~is_dense).any():
                sk.add(counters, c[own][~is_dense], w[own][~is_dense])
            at = np.flatnonzero(counters)
            parts.append((np.full(len(at), k), at, counters[at]))
        g, c, w = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(g, kind="stable")
        g, c, w = g[order], c[order], w[order]
    return np.searchsorted(g, np.arange(n_groups + 1)), kinds, c, w


def _state_table(keys: pa.Table, totals: np.ndarray, offsets: np.ndarray, kinds: np.ndarray, cells: np.ndarray, counts: np.ndarray) -> pa.Table:
    off = pa.array(offsets.astype(np.int32))
    out = keys.append_column("n", pa.array(totals.astype(np.int64))).append_column("dense", pa.array(kinds))
    out = out.append_column("cells", pa.ListArray.from_arrays(off, pa.array(cells.astype(np.int64))))
    return out.append_column("counts", pa.ListArray.from_arrays(off, pa.array(counts.astype(np.int64))))


def _from_values(sk: Sketch, t: pa.Table, keys: Sequence[str]) -> pa.Table:
    gid, first = _groups(t.select(keys))
    values = t["__value"].to_numpy()
    weights = t["__weight"].to_numpy().astype(np.int64)
    offsets, kinds, cells, counts = _fold(sk, gid, len(first), np.zeros(len(gid), dtype=bool), sk.encode(values), weights)
    totals = np.zeros(len(first), dtype=np.int64)
    np.add.at(totals, gid, weights)
    return _state_table(t.select(keys).take(pa.array(first)), totals, offsets, kinds, cells, counts)


def _flat(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a table of states: entries per row, cells, counts."""
    cells, counts = (t[c].combine_chunks() for c in ("cells", "counts"))
    cells, counts = ((x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x) for x in (cells, counts))
    lengths = np.diff(cells.offsets.to_numpy())
    return lengths, cells.flatten().to_numpy(zero_copy_only=False), counts.flatten().to_numpy(zero_copy_only=False)


def _from_states(sk: Sketch, t: pa.Table, keys: Sequence[str]) -> pa.Table:
    gid, first = _groups(t.select(keys))
    lengths, cells, counts = _flat(t)
    dense = t["dense"].to_numpy(zero_copy_only=False).astype(bool)
    offsets, kinds, cells, counts = _fold(sk, np.repeat(gid, lengths), len(first), np.repeat(dense, lengths), cells, counts)
    kinds[gid[dense]] = True
    totals = np.zeros(len(first), dtype=np.int64)
    np.add.at(totals, gid, t["n"].to_numpy())
    return _state_table(t.select(keys).take(pa.array(first)), totals, offsets, kinds, cells, counts)


def _read_out(sk: Sketch, t: pa.Table, keys: Sequence[str], probs: Sequence[float]) -> pa.Table:
    """Percentiles of merged states. Counts below zero (deletions of what was never added) count as zero."""
    lengths, cells, counts = _flat(t)
    dense = t["dense"].to_numpy(zero_copy_only=False).astype(bool)
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    run = np.concatenate([[0], np.cumsum(np.where(np.repeat(dense, lengths), 0, np.maximum(counts, 0)))])
    n = np.where(dense, np.maximum(t["n"].to_numpy(), 0), run[offsets[1:]] - run[offsets[:-1]])
    out = np.zeros((len(probs), t.num_rows), dtype=np.int64)
    for i, p in enumerate(probs):
        target = np.clip(np.ceil(p * n), 1, np.maximum(n, 1)).astype(np.int64)
        at = np.searchsorted(run[1:], run[offsets[:-1]] + target)
        sparse = ~dense & (n > 0)
        out[i, sparse] = cells[at[sparse]]
    for k in np.flatnonzero(dense):
        counters = np.zeros(sk.cells, dtype=np.int64)
        own = slice(offsets[k], offsets[k + 1])
        counters[cells[own]] = counts[own]
        out[:, k] = sk.invert(counters, np.clip(np.ceil(np.array(probs) * n[k]), 1, max(n[k], 1)))
    table = t.select(keys).append_column("n", pa.array(n)).append_column("exact", pa.array(~dense))
    for i, p in enumerate(probs):
        table = table.append_column(column_of(p), pa.array(sk.decode(out[i]), mask=n == 0))
    return table


def column_of(p: float) -> str:
    """The column of percentile ``p``: p50 for 0.5, p99_9 for 0.999."""
    return "p" + f"{100 * p:g}".replace(".", "_")


# -- Spark -----------------------------------------------------------------------------------------------------------------------


def _state_fields(df: DataFrame, keys: Sequence[str]) -> list[T.StructField]:
    longs = T.ArrayType(T.LongType())
    return [*(df.schema[k] for k in keys), T.StructField("n", T.LongType()), T.StructField("dense", T.BooleanType()), T.StructField("cells", longs), T.StructField("counts", longs)]


def _batches(t: pa.Table, rows: int) -> Iterator[pa.RecordBatch]:
    for b in t.combine_chunks().to_batches(max_chunksize=rows):
        yield b


def summarise(df: DataFrame, keys: Sequence[str], value: str, weight: str | None = None, sk: Sketch = Sketch()) -> DataFrame:
    """Partial states (keys, n, dense, cells, counts) of each task's rows: several per group, to be merged by :func:`merge`.

    ``value`` is any numeric column; null and NaN values are skipped. ``weight`` is a column of whole numbers, 1 for a row that
    is added and -1 for one that is taken back; null counts as 0. Null keys are a group. Only the named columns are read.
    A task holds at most ``FLUSH`` rows and ``4 * FLUSH`` entries of states at a time, whatever its share of the rows. Where it has to
    give some away before its end, large groups stay, so that a group with many rows leaves a task as one state.
    """
    cols = list(keys)
    rows = df.select(*cols, F.col(value).cast("double").alias("__value"), (F.coalesce(F.col(weight).cast("bigint"), F.lit(0)) if weight else F.lit(1).cast("bigint")).alias("__weight"))
    rows = rows.where(F.col("__value").isNotNull() & ~F.isnan("__value"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        states: pa.Table | None = None
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= FLUSH:
                states = _together(states, _from_values(sk, pa.Table.from_batches(held), cols))
                held, n = [], 0
                if _entries(states) > 4 * FLUSH:
                    out, states = _divide(_from_states(sk, states, cols))
                    yield from _batches(out, 2000)
        if n:
            states = _together(states, _from_values(sk, pa.Table.from_batches(held), cols))
        if states is not None:
            yield from _batches(_from_states(sk, states, cols) if len(states["cells"].chunks) > 1 else states, 2000)

    return rows.mapInArrow(fold, T.StructType(_state_fields(rows, cols)))


def _together(states: pa.Table | None, more: pa.Table) -> pa.Table:
    return more if states is None else pa.concat_tables([states, more])


def _entries(states: pa.Table) -> int:
    return sum(len(c.flatten()) for c in states["cells"].chunks)


def _divide(states: pa.Table) -> tuple[pa.Table, pa.Table]:
    """What a full task passes on, and what it keeps: the largest groups, up to ``FLUSH`` entries."""
    size = pc.list_value_length(states["cells"]).to_numpy(zero_copy_only=False).astype(np.int64)
    order = np.argsort(-size, kind="stable")
    stays = np.zeros(len(size), dtype=bool)
    stays[order[np.cumsum(size[order]) <= FLUSH]] = True
    stays &= size > FLUSH >> 10
    return states.filter(pa.array(~stays)), states.filter(pa.array(stays))


def _merged(sk: Sketch, cols: list[str], probs: Sequence[float] | None):
    """A function for mapInArrow over states that are sorted by key: one state, or one row of percentiles, per key."""

    def done(t: pa.Table) -> Iterator[pa.RecordBatch]:
        if t.num_rows:
            yield from _batches(t if probs is None else _read_out(sk, t, cols, probs), 2000)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        entries = 0
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t])
            entries += len(b.column("cells").flatten())
            if entries < FLUSH:
                continue
            last = held.slice(held.num_rows - 1).select(cols).to_pylist()[0]
            merged = _from_states(sk, held, cols)
            open_ = pa.array([row == last for row in merged.select(cols).to_pylist()])  # its states may go on in the next batch
            yield from done(merged.filter(pc.invert(open_)))
            held = merged.filter(open_)
            entries = len(held["cells"].combine_chunks().flatten())
            entries = 0 if entries >= FLUSH else entries
        if held is not None:
            yield from done(_from_states(sk, held, cols))

    return fold


def _rounds(df: DataFrame, fan_in: int) -> int:
    """How many rounds of merging keep a task from getting more than about ``fan_in`` states of a group.

    A large group has one state per task, so the number of tasks counts: of files by their size, else the partitions there are.
    """
    spark = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size < 1 << 60:
        tasks = size / spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    else:  # rows in memory or from a checkpoint, whose size Spark doesn't know
        tasks = df.rdd.getNumPartitions()
    return max(1, math.ceil(math.log(max(2.0, tasks)) / math.log(fan_in)))


def merge(states: DataFrame, keys: Sequence[str], sk: Sketch = Sketch(), rounds: int | None = None, probs: Sequence[float] | None = None, fan_in: int = 64) -> DataFrame:
    """One state per group, or its percentiles if ``probs`` are given: (keys, n, exact, p50, ...).

    With several rounds, as many as the number of tasks that give states asks for, the states of a group are first merged under ``fan_in``^k salts, so that a group with states from every
    task of a very large input isn't gathered in one task. ``states`` may hold states of any number of days or runs.
    """
    cols = list(keys)
    for r in range((_rounds(states, fan_in) if rounds is None else rounds) - 1, 0, -1):
        salted = states.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(fan_in**r)))
        salted = salted.repartition(*cols, "__salt").sortWithinPartitions(*cols, "__salt")
        fields = _state_fields(salted, [*cols, "__salt"])
        states = salted.mapInArrow(_merged(sk, [*cols, "__salt"], None), T.StructType(fields)).drop("__salt")
    fields = _state_fields(states, cols)
    if probs is not None:
        fields = [*fields[: len(cols)], T.StructField("n", T.LongType()), T.StructField("exact", T.BooleanType()), *(T.StructField(column_of(p), T.DoubleType()) for p in probs)]
    return states.repartition(*cols).sortWithinPartitions(*cols).mapInArrow(_merged(sk, cols, probs), T.StructType(fields))


def percentiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float] = (0.5, 0.9, 0.99), weight: str | None = None, sk: Sketch = Sketch()) -> DataFrame:
    """(keys, n, exact, p50, p90, p99): per group the values at rank ceil(p * n), n the group's non-null values.

    Groups without any value give no row; a group whose values were all taken back has n 0 and null percentiles.
    """
    return merge(summarise(df, keys, value, weight, sk), keys, sk, _rounds(df, 64), probs)
