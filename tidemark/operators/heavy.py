"""Per-key aggregates when a few keys hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.exact import from_parts, sum_parts


def per_key(rows: DataFrame, key: str = "name", value: str = "value") -> DataFrame:
    """(key, row_count, value_count, sum_value DECIMAL(38,0), max_value, min_value), one row per distinct key.

    All aggregates are algebraic with fixed-width states, so every task folds its rows into a bounded hash table, spilling by
    sort when it is full, and only one state per task and key is shuffled: a key with any share of the rows costs the reducer one
    row per map task. Null is a key of its own, and so is the empty string. Null values are skipped; a key with null values only
    has null sum, max and min. Empty input gives no row. Only the two named columns are read.
    """
    v = F.col(value).cast("bigint")
    agg = rows.select(F.col(key).alias("__key"), v.alias("__value")).groupBy("__key").agg(
        F.count(F.lit(1)).alias("row_count"), F.count("__value").alias("value_count"), *sum_parts(F.col("__value"), "s"), F.max("__value").alias("max_value"), F.min("__value").alias("min_value")
    )
    return agg.select(F.col("__key").alias(key), "row_count", "value_count", from_parts("s").alias("sum_value"), "max_value", "min_value")


def heavy_keys(rows: DataFrame, key: str = "name", value: str = "value", share: tuple[int, int] = (1, 100)) -> DataFrame:
    """:func:`per_key` of the keys that hold at least ``share`` (a fraction) of all rows, null and empty keys included in "all".

    The number of all rows is a scalar subquery: counted when the query runs, from a scan without columns.
    """
    total = rows.agg(F.count(F.lit(1))).scalar()
    return per_key(rows, key, value).where(F.col("row_count") * share[1] >= total * share[0])
