"""Rolling totals over trailing days by event-contribution deltas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.exact import from_parts, sum_parts

DAY_MS = 86_400_000
#: Days from 1970 that a DATE, 32 bits wide, can hold, with room for the longest windows.
FIRST_DAY, LAST_DAY = -2_147_000_000, 2_147_000_000


def _day(ts: str) -> Column:
    """The UTC day of epoch milliseconds; null without a time, or with one that no DATE can hold."""
    t, of = F.col(ts).cast("bigint"), F.lit(DAY_MS).cast("bigint")
    day = F.call_function("div", t, of) - F.when((t < 0) & (t % of != 0), 1).otherwise(0)  # div cuts towards zero
    return F.when(day.between(FIRST_DAY, LAST_DAY), day.cast("int"))


def undated(rows: DataFrame, key: str = "name", ts: str = "timestamp", value: str = "value") -> DataFrame:
    """(key, reason, rows, n, total): what :func:`rolling_totals` has no day for: ``untimed`` rows, and rows ``out of range`` of a DATE."""
    odd = rows.select(F.col(key).alias("__key"), F.when(F.col(ts).isNull(), "untimed").when(_day(ts).isNull(), "out of range").alias("__why"), F.col(value).cast("bigint").alias("__v"))
    agg = odd.where(F.col("__why").isNotNull()).groupBy("__key", "__why").agg(F.count(F.lit(1)).alias("rows"), F.count("__v").alias("n"), *sum_parts(F.col("__v"), "s"))
    return agg.select(F.col("__key").alias(key), F.col("__why").alias("reason"), "rows", "n", from_parts("s").alias("total"))


def daily(rows: DataFrame, key: str = "name", ts: str = "timestamp", value: str = "value") -> DataFrame:
    """(key, day, rows, n, total): per key and UTC day the rows, the non-null values and their exact sum. The rows without a day are :func:`undated`."""
    timed = rows.select(F.col(key).alias("__key"), _day(ts).alias("__day"), F.col(value).cast("bigint").alias("__v")).where(F.col("__day").isNotNull())
    agg = timed.groupBy("__key", "__day").agg(F.count(F.lit(1)).alias("__rows"), F.count("__v").alias("__n"), *sum_parts(F.col("__v"), "s"))
    return agg.select("__key", "__day", "__rows", "__n", F.coalesce(from_parts("s"), F.lit(0).cast("decimal(38,0)")).alias("__total"))


def rolling_totals(rows: DataFrame, windows: tuple[int, ...] = (7, 30), key: str = "name", ts: str = "timestamp", value: str = "value") -> DataFrame:
    """Per key and UTC day from the key's first to its last, quiet days included: totals, counts and averages over trailing days.

    Columns: key, ``day`` DATE, ``rows_today``, and for each length w ``total_{w}d`` DECIMAL(38,0), ``n_{w}d`` (non-null values) and
    ``avg_{w}d`` (mean of those values; null without any; a quiet window has total 0). Times are epoch milliseconds; rows
    without a day (no time, or one beyond the 32 bits of a DATE) are in no total and come out of :func:`undated`; a null key is a key. Only the named columns are read. Empty input gives no row.

    Each daily amount is a delta +a on its day and -a once it is w days old. The running sum of a key's deltas is a step
    function that only changes at deltas, so it is computed there alone and each step is then spread over its days: a quiet day costs
    no join. Rows are combined per key and day before any shuffle; what is ordered in one task is a key's days, not its rows.
    """
    zero = F.lit(0).cast("decimal(38,0)")

    def delta(after: int, sign: int, of: tuple[int, ...], own: bool) -> F.Column:
        parts = [(F.col("__day") + after).alias("d"), (F.col("__rows") if own else F.lit(0).cast("bigint")).alias("rows"), (F.col("__day") if own else F.lit(None).cast("int")).alias("real")]
        for w in windows:
            parts += [(F.col("__total") * sign if w in of else zero).cast("decimal(38,0)").alias(f"t{w}"), (F.col("__n") * sign if w in of else F.lit(0).cast("bigint")).alias(f"n{w}")]
        return F.struct(*parts)

    each = daily(rows, key, ts, value).repartition("__key")
    changes = each.select("__key", F.explode(F.array(delta(0, 1, windows, True), *(delta(w, -1, (w,), False) for w in windows))).alias("x")).select("__key", "x.*")
    sums = [F.sum(f"{c}{w}").alias(f"{c}{w}") for w in windows for c in "tn"]
    points = changes.groupBy("__key", "d").agg(F.sum("rows").alias("rows"), F.max("real").alias("real"), *sums)
    w_all = Window.partitionBy("__key").orderBy("d")
    run = w_all.rowsBetween(Window.unboundedPreceding, 0)
    steps = points.select(
        "__key", "d", "rows", F.lead("d").over(w_all).alias("next"), F.max("real").over(Window.partitionBy("__key")).alias("last"),
        *(F.sum(f"{c}{w}").over(run).alias(f"{c}{w}") for w in windows for c in "tn"),
    ).where(F.col("d") <= F.col("last"))
    days = steps.withColumn("day", F.explode(F.sequence(F.col("d"), F.least(F.coalesce(F.col("next") - 1, F.col("d")), F.col("last")))))
    out = [F.col("__key").alias(key), F.date_from_unix_date("day").alias("day"), F.when(F.col("day") == F.col("d"), F.col("rows")).otherwise(F.lit(0).cast("bigint")).alias("rows_today")]
    for w in windows:
        total = F.col(f"t{w}").cast("decimal(38,0)")
        out += [total.alias(f"total_{w}d"), F.col(f"n{w}").alias(f"n_{w}d"), F.when(F.col(f"n{w}") > 0, total.cast("double") / F.col(f"n{w}")).alias(f"avg_{w}d")]
    return days.select(*out)
