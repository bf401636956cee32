"""Scalar helpers: times, hashes and JSON."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Date formats.
TIME_ZONED = "HH:mm:ssZ"
DATE_TIME = "yyyy-MM-dd HH:mm:ss"
DATE_TIME_MILLIS = "yyyy-MM-dd'T'HH:mm:ss.SSS"


def current_timestamp_millis() -> Column:
    """Now in epoch milliseconds; the same for all rows of a query or micro-batch."""
    return F.unix_millis(F.current_timestamp())


def current_timestamp() -> Column:
    """Now in epoch seconds."""
    return F.unix_seconds(F.current_timestamp())


def timestamp_of(ms: Column) -> Column:
    return F.timestamp_millis(ms)


def millis_of(ts: Column) -> Column:
    """Epoch milliseconds of a timestamp; one without zone is taken in the session's."""
    return F.unix_millis(ts.cast("timestamp"))


def format_ms(ms: Column, fmt: str = DATE_TIME) -> Column:
    """Epoch milliseconds in the session's zone."""
    return F.date_format(F.timestamp_millis(ms), fmt)


def timestamp_str(ms: Column) -> Column:
    """Formatted and raw."""
    return F.concat(format_ms(ms, DATE_TIME_MILLIS), F.lit("("), ms.cast("string"), F.lit(")"))


def in_zone(ms: Column, zone: str = "Asia/Shanghai") -> Column:
    return F.from_utc_timestamp(F.timestamp_millis(ms), zone)


def hash_code(*cols: Column) -> Column:
    """Murmur3, seed 42."""
    return F.hash(*cols)


def decode_json(payload: Column, schema: T.StructType | str) -> Column:
    """A struct from a JSON payload, STRING or BINARY; null where it is null or no JSON."""
    return F.from_json(payload.cast("string"), schema)


def encode_json(*cols: Column | str) -> Column:
    return F.to_json(F.struct(*cols))


def new_id(prefix: str) -> str:
    return f"{prefix}-{uuid.uuid4().hex[:16]}"
