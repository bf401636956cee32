"""Column types of stream schemas and their Spark types. Unsigned integers take the next wider signed type."""

from __future__ import annotations

from pyspark.sql import types as T

UINT64 = T.DecimalType(20, 0)

SPARK_TYPES: dict[str, T.DataType] = {
    "boolean": T.BooleanType(),
    "i8": T.ByteType(),
    "u8": T.ShortType(),
    "i16": T.ShortType(),
    "u16": T.IntegerType(),
    "i32": T.IntegerType(),
    "u32": T.LongType(),
    "i64": T.LongType(),
    "u64": UINT64,
    "f32": T.FloatType(),
    "f64": T.DoubleType(),
    "binary": T.BinaryType(),
    "string": T.StringType(),
}


def schema(*fields: tuple[str, str], times_as_long: bool = True) -> T.StructType:
    """A schema from (name, type) pairs. With ``times_as_long`` u64 is LONG, as for epoch milliseconds and counts, else DECIMAL(20,0)."""
    unknown = sorted({t for _, t in fields} - set(SPARK_TYPES))
    if unknown:
        raise ValueError(f"unknown types: {unknown}")
    return T.StructType([T.StructField(n, T.LongType() if t == "u64" and times_as_long else SPARK_TYPES[t]) for n, t in fields])


def sub_schema(s: T.StructType, columns: list[int | str]) -> T.StructType:
    return T.StructType([s.fields[locate(s, c)] for c in columns])


def locate(s: T.StructType, column: int | str) -> int:
    """A column's position, by index or by name (the first of that name)."""
    if isinstance(column, int):
        if not -len(s) <= column < len(s):
            raise ValueError(f"no column {column} among {len(s)}")
        return column % len(s)
    if column not in s.names:
        raise ValueError(f"no column {column!r} among {s.names}")
    return s.names.index(column)


def is_numeric(t: T.DataType) -> bool:
    return isinstance(t, T.NumericType)


MODEL = schema(("timestamp", "u64"), ("name", "string"), ("value", "i64"))
CONFIG = schema(("field", "string"), ("value", "string"))
OUTPUT = schema(("field", "string"), ("value", "i64"), ("pct_99", "i64"), ("pct_90", "i64"))
KAFKA_MESSAGE = schema(("timestamp", "i64"), ("key", "binary"), ("payload", "binary"), ("topic", "string"), ("partition", "i32"), ("offset", "i64"))
CHECKPOINT_DATA = schema(("ts", "u64"), ("app", "string"), ("count", "i64"))
