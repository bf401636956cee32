"""The registered queries of the stream operators: windows, aggregates, percentiles, filters, row transforms, connects, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import aggregates as A
from tidemark.functions import histogram, scalars, windows
from tidemark.operators import late
from tidemark.plans.registry import Registry
from tidemark.plans.stream import Stream
from tidemark.session import scratch, table
from tidemark.sources import kafka, sinks
from tidemark.streaming import runner
from tidemark.streaming.watermarks import bounded
from tidemark.types import CHECKPOINT_DATA, MODEL

REGISTRY = Registry()
QUERIES, SQL, query = REGISTRY.queries, REGISTRY.sql, REGISTRY.query

HOUR, DAY = 3_600_000, 86_400_000


# -- inputs. Money is counted in cents, so that sums don't depend on the order of addition.

_EVENTS = "(SELECT event_id, (EPOCH_US(ts) // 1000) AS t, event_type, user_id, CAST(ROUND(value * 100) AS BIGINT) AS cents, props FROM events)"
_MODEL = '(SELECT "timestamp" AS t, name, value FROM stream_table WHERE "timestamp" IS NOT NULL)'
_ORDERS = "(SELECT (EPOCH_US(o_orderdate) // 1000) AS t, o_orderstatus, o_orderpriority, o_custkey, CAST(ROUND(o_totalprice * 100) AS BIGINT) AS cents FROM orders)"
_LINES = "(SELECT (EPOCH_US(l_shipdate) // 1000) AS t, l_returnflag, l_linestatus, l_linenumber, CAST(ROUND(l_quantity * 100) AS BIGINT) AS quantity FROM lineitem)"


def _events(spark: SparkSession, d: str) -> Stream:
    df = table(spark, d, "events")
    rows = df.select("event_id", scalars.millis_of(F.col("ts")).alias("t"), "event_type", "user_id", F.round(F.col("value") * 100).cast("bigint").alias("cents"), "props")
    return Stream(rows).assign_timestamps(bounded(1000).with_timestamps("t"))


def _model(spark: SparkSession, d: str) -> Stream:
    return Stream(table(spark, d, "stream_table").select("timestamp", "name", "value")).assign_timestamps(bounded(1000).with_timestamps("timestamp"))


def _orders(spark: SparkSession, d: str) -> Stream:
    df = table(spark, d, "orders")
    rows = df.select(scalars.millis_of(F.col("o_orderdate")).alias("t"), "o_orderstatus", "o_orderpriority", "o_custkey", F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"))
    return Stream(rows).assign_timestamps(bounded(0).with_timestamps("t"))


def _lines(spark: SparkSession, d: str) -> Stream:
    df = table(spark, d, "lineitem")
    rows = df.select(scalars.millis_of(F.col("l_shipdate")).alias("t"), "l_returnflag", "l_linestatus", "l_linenumber", F.round(F.col("l_quantity") * 100).cast("bigint").alias("quantity"))
    return Stream(rows).assign_timestamps(bounded(0).with_timestamps("t"))


def _four(column: str) -> list[A.Agg]:
    return [A.sum_(column).named("sum_value"), A.max_(column).named("max_value"), A.min_(column).named("min_value"), A.count().named("row_count")]


def _four_sql(column: str) -> str:
    return f"CAST(SUM({column}) AS BIGINT) AS sum_value, MAX({column}) AS max_value, MIN({column}) AS min_value, COUNT(*) AS row_count"


def _hop_rows(source: str, size: int, slide: int, offset: int = 0) -> str:
    k = -(-size // slide)
    start = f"t - ((t - ({offset})) % {slide} + {slide}) % {slide} - k * {slide}"
    return f"(SELECT *, window_start + {size} AS window_end FROM (SELECT *, {start} AS window_start FROM {source}, RANGE(0, {k}) AS r(k)) WHERE window_start >= 0 AND t < window_start + {size})"


def _hop_sql(source: str, keys: str, aggs: str, size: int, slide: int | None = None, offset: int = 0) -> str:
    return f"SELECT {keys}, {aggs}, window_start, window_end FROM {_hop_rows(source, size, slide or size, offset)} GROUP BY {keys}, window_start, window_end"


# -- windows and aggregates


@query(_hop_sql(_EVENTS, "event_type", _four_sql("cents"), 6 * HOUR, 2 * HOUR))
def hop_sum_max_min_count(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).key_by("event_type").window(windows.hop(6 * HOUR, 2 * HOUR)).reduce(*_four("cents")).df


@query(_hop_sql(_MODEL, "name", _four_sql("value"), 60_000, 20_000))
def hop_example_60s_20s(spark: SparkSession, d: str) -> DataFrame:
    return _model(spark, d).key_by("name").window(windows.hop(60_000, 20_000)).reduce(*_four("value")).df


@query(_hop_sql(_MODEL, "name", _four_sql("value"), DAY, HOUR))
def hop_shared_panes(spark: SparkSession, d: str) -> DataFrame:
    return _model(spark, d).key_by("name").window(windows.hop(DAY, HOUR)).reduce(*_four("value"), share_panes=True).df


@query(_hop_sql(_EVENTS, "event_type", "COUNT(*) AS row_count", 5 * HOUR, 2 * HOUR))
def hop_uneven(spark: SparkSession, d: str) -> DataFrame:
    """Windows whose size is no multiple of the slide."""
    return _events(spark, d).key_by("event_type").window(windows.hop(5 * HOUR, 2 * HOUR)).reduce(A.count().named("row_count")).df


@query(_hop_sql(_EVENTS, "event_type", "COUNT(*) AS row_count", HOUR, 3 * HOUR))
def hop_gapped(spark: SparkSession, d: str) -> DataFrame:
    """A slide beyond the size: rows in the gaps are in no window."""
    return _events(spark, d).key_by("event_type").window(windows.hop(HOUR, 3 * HOUR)).reduce(A.count().named("row_count")).df


@query(_hop_sql(_EVENTS, "event_type", "COUNT(*) AS row_count", DAY))
def tumble_count(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).key_by("event_type").window(windows.tumble(DAY)).reduce(A.count().named("row_count")).df


@query(_hop_sql(_EVENTS, "user_id", "CAST(SUM(cents) AS BIGINT) AS sum_value", 12 * HOUR))
def tumble_sum(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).key_by("user_id").window(windows.tumble(12 * HOUR)).reduce(A.sum_("cents").named("sum_value")).df


@query(_hop_sql(_EVENTS, "event_type", _four_sql("cents"), DAY, offset=-8 * HOUR))
def tumble_offset_back_8h(spark: SparkSession, d: str) -> DataFrame:
    """Days of UTC+8."""
    return _events(spark, d).key_by("event_type").window(windows.tumble(DAY, -8 * HOUR)).reduce(*_four("cents")).df


@query(_hop_sql(_EVENTS, "event_type", _four_sql("cents"), DAY, offset=5 * HOUR))
def tumble_offset_forward(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).key_by("event_type").window(windows.tumble(DAY, 5 * HOUR)).reduce(*_four("cents")).df


@query(_hop_sql(_EVENTS, "event_type", _four_sql("cents"), DAY, 8 * HOUR, -7 * HOUR))
def hop_offset(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).key_by("event_type").window(windows.hop(DAY, 8 * HOUR, -7 * HOUR)).reduce(*_four("cents")).df


@query(_hop_sql(_EVENTS, "event_type, user_id", _four_sql("cents"), 2 * DAY, DAY))
def hop_multi_key(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).key_by("event_type", "user_id").window(windows.hop(2 * DAY, DAY)).reduce(*_four("cents")).df


@query(_hop_sql(_EVENTS, "event_type", "COUNT(*) AS row_count", DAY))
def key_by_index(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).key_by(2).window(windows.tumble(DAY)).reduce(A.count().named("row_count")).df


@query(_hop_sql(_MODEL, "name", "COUNT(*) AS row_count", 30 * DAY))
def agg_count(spark: SparkSession, d: str) -> DataFrame:
    return _model(spark, d).key_by("name").window(windows.tumble(30 * DAY)).reduce(A.count().named("row_count")).df


@query(_hop_sql(_MODEL, "name", "CAST(SUM(value) AS BIGINT) AS sum_value", DAY))
def agg_sum(spark: SparkSession, d: str) -> DataFrame:
    return _model(spark, d).key_by("name").window(windows.tumble(DAY)).reduce(A.sum_("value").named("sum_value")).df


@query(_hop_sql(_MODEL, "name", "MAX(value) AS max_value", DAY))
def agg_max(spark: SparkSession, d: str) -> DataFrame:
    return _model(spark, d).key_by("name").window(windows.tumble(DAY)).reduce(A.max_("value").named("max_value")).df


@query(_hop_sql(_MODEL, "name", "MIN(value) AS min_value", DAY))
def agg_min(spark: SparkSession, d: str) -> DataFrame:
    return _model(spark, d).key_by("name").window(windows.tumble(DAY)).reduce(A.min_("value").named("min_value")).df


@query(_hop_sql(_LINES, "l_returnflag", "CAST(SUM(l_linenumber) AS BIGINT) AS sum_line, CAST(MAX(l_linenumber) AS INTEGER) AS max_line", 30 * DAY))
def agg_sum_int_widened(spark: SparkSession, d: str) -> DataFrame:
    """Sums of INT come out as LONG, maxima as INT."""
    return _lines(spark, d).key_by("l_returnflag").window(windows.tumble(30 * DAY)).reduce(A.sum_("l_linenumber").named("sum_line"), A.max_("l_linenumber").named("max_line")).df


@query(_hop_sql(_ORDERS, "o_orderstatus", _four_sql("cents"), DAY))
def orders_daily(spark: SparkSession, d: str) -> DataFrame:
    return _orders(spark, d).key_by("o_orderstatus").window(windows.tumble(DAY)).reduce(*_four("cents")).df


@query(_hop_sql(_LINES, "l_returnflag, l_linestatus", _four_sql("quantity"), 28 * DAY, 7 * DAY))
def lineitem_monthly_hop(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d).key_by("l_returnflag", "l_linestatus").window(windows.hop(28 * DAY, 7 * DAY)).reduce(*_four("quantity")).df


@query(f"SELECT event_id, window_start, window_end FROM {_hop_rows(_EVENTS, 6 * HOUR, 2 * HOUR)}")
def window_assign_only(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).key_by("event_type").window(windows.hop(6 * HOUR, 2 * HOUR)).assigned().select("event_id", "window_start", "window_end")


@query(f"SELECT event_type, COUNT(*) AS row_count, t - t % {DAY} AS window_start, t - t % {DAY} + CASE WHEN t // {DAY} % 2 = 0 THEN {DAY} ELSE {HOUR} END AS window_end FROM {_EVENTS} GROUP BY ALL")
def custom_window(spark: SparkSession, d: str) -> DataFrame:
    """A custom assigner: even days whole, odd days as one-hour labels."""

    def assign(ts: F.Column) -> F.Column:
        start = windows.window_start(ts, 0, DAY)
        return F.array(F.struct(start.alias("start"), (start + F.when((start / DAY).cast("bigint") % 2 == 0, DAY).otherwise(HOUR)).alias("end")))

    return _events(spark, d).key_by("event_type").window(assign).reduce(A.count().named("row_count")).df


@query(f"""SELECT event_type, window_start, window_end, CAST(SUM(cents * cents) AS BIGINT) AS squares, COUNT(*) AS n
    FROM {_hop_rows(_EVENTS, DAY, DAY)} GROUP BY ALL""")
def custom_fold(spark: SparkSession, d: str) -> DataFrame:
    def step(acc: dict | None, row: dict) -> dict:
        acc = acc or {"squares": 0, "n": 0}
        return {"squares": acc["squares"] + int(row["cents"]) ** 2, "n": acc["n"] + 1}

    def merge(a: dict, b: dict) -> dict:
        return {"squares": int(a["squares"]) + int(b["squares"]), "n": int(a["n"]) + int(b["n"])}

    return _events(spark, d).key_by("event_type").window(windows.tumble(DAY)).fold(step, merge, "squares bigint, n bigint").df


# -- percentiles over a scale

SCALE = histogram.SCALE_90
_BOUNDS = f"[{', '.join(map(str, SCALE))}]"


def _hist_sql(rows: str, keys: str, column: str, extra: str = "") -> str:
    return f"""binned AS (SELECT {keys}, LEAST(LEN(LIST_FILTER({_BOUNDS}, lambda x: x < {column})), {len(SCALE) - 1}) AS bucket FROM {rows} WHERE {column} IS NOT NULL),
        counted AS (SELECT {keys}, bucket, COUNT(*) AS n FROM binned GROUP BY ALL)"""


def _pct_sql(rows: str, keys: str, column: str, ps: tuple[int, ...]) -> str:
    pos = lambda p: f"GREATEST(1, LEAST(total, CAST(FLOOR(total * CAST({(100 - p) / 100} AS DOUBLE)) AS BIGINT)))"
    return f"""WITH {_hist_sql(rows, keys, column)},
        seen AS (SELECT {keys}, bucket, SUM(n) OVER (PARTITION BY {keys} ORDER BY bucket DESC) AS above, SUM(n) OVER (PARTITION BY {keys}) AS total FROM counted)
        SELECT {keys}, {', '.join(f"CAST(MAX(CASE WHEN above >= {pos(p)} THEN {_BOUNDS}[bucket + 1] END) AS DOUBLE) AS pct_{p}" for p in ps)} FROM seen GROUP BY {keys}"""


_VALUES = "(SELECT event_type, user_id, t, cents // 100 AS whole FROM " + _EVENTS + ")"


def _whole(spark: SparkSession, d: str) -> Stream:
    e = _events(spark, d)
    return e._with(e.df.withColumn("whole", F.floor(F.col("cents") / 100)))


@query(f"WITH {_hist_sql(_hop_rows(_VALUES, 30 * DAY, 30 * DAY), 'event_type, window_start, window_end', 'whole')} SELECT event_type, window_start, window_end, bucket, n FROM counted")
def pct_histogram(spark: SparkSession, d: str) -> DataFrame:
    out = _whole(spark, d).key_by("event_type").window(windows.tumble(30 * DAY)).reduce(A.pct("whole", SCALE).named("hist")).df
    return out.select("event_type", "window_start", "window_end", F.explode("hist").alias("bucket", "n"))


@query(_pct_sql(_hop_rows(_VALUES, 30 * DAY, 30 * DAY), "event_type, window_start, window_end", "whole", (50, 90, 99)))
def pct_p50_p90_p99(spark: SparkSession, d: str) -> DataFrame:
    out = _whole(spark, d).key_by("event_type").window(windows.tumble(30 * DAY)).reduce(A.pct("whole", SCALE).named("hist")).df
    return out.select("event_type", "window_start", "window_end", *(A.pct_value(F.col("hist"), SCALE, p).alias(f"pct_{p}") for p in (50, 90, 99)))


@query(f"""WITH p AS ({_pct_sql(_hop_rows(_VALUES, 2 * DAY, DAY // 4), 'event_type, window_start, window_end', 'whole', (90, 99))}),
    c AS (SELECT event_type, window_start, window_end, COUNT(*) AS row_count, CAST(MAX(whole) AS BIGINT) AS max_value FROM {_hop_rows(_VALUES, 2 * DAY, DAY // 4)} GROUP BY ALL)
    SELECT p.*, row_count, max_value FROM p JOIN c ON p.event_type = c.event_type AND p.window_start = c.window_start AND p.window_end = c.window_end""")
def hop_pct(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles beside other aggregates, over shared panes."""
    out = _whole(spark, d).key_by("event_type").window(windows.hop(2 * DAY, DAY // 4)).reduce(A.pct("whole", SCALE).named("hist"), A.count().named("row_count"), A.max_("whole").named("max_value")).df
    return out.select("event_type", "window_start", "window_end", "row_count", "max_value", *(A.pct_value(F.col("hist"), SCALE, p).alias(f"pct_{p}") for p in (90, 99)))


# -- filters and row transforms


@query(f"SELECT event_id, event_type, cents FROM {_EVENTS} WHERE event_type = 'click' AND cents > 5000")
def filter_predicate(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).filter((F.col("event_type") == "click") & (F.col("cents") > 5000)).map("event_id", "event_type", "cents").df


_FROM, _TO = 1_704_672_000_000, 1_705_708_800_000  # 2024-01-08 to 2024-01-20


@query(f"SELECT * FROM ({_hop_sql(_EVENTS, 'event_type', 'COUNT(*) AS row_count', 2 * DAY, DAY)}) WHERE window_start >= {_FROM} AND window_end <= {_TO}")
def filter_window_range(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).key_by("event_type").window(windows.hop(2 * DAY, DAY)).reduce(A.count().named("row_count")).filter_windows(_FROM, _TO).df


@query(f"SELECT * FROM ({_hop_sql(_EVENTS, 'event_type', 'COUNT(*) AS row_count', 2 * DAY, DAY)}) WHERE window_start >= {_TO} OR window_end <= {_FROM}")
def filter_window_or_range(spark: SparkSession, d: str) -> DataFrame:
    out = _events(spark, d).key_by("event_type").window(windows.hop(2 * DAY, DAY)).reduce(A.count().named("row_count"))
    return out.filter((F.col("window_start") >= _TO) | (F.col("window_end") <= _FROM)).df


@query("SELECT name, value, \"timestamp\" FROM stream_table")
def flat_map_identity(spark: SparkSession, d: str) -> DataFrame:
    rows = Stream(table(spark, d, "stream_table").select("timestamp", "name", "value"))
    return rows.flat_map(F.array(F.struct("timestamp", "name", "value"))).df


@query("SELECT word, COUNT(*) AS n FROM (SELECT UNNEST(STRING_SPLIT(text, ' ')) AS word FROM documents) WHERE word <> '' GROUP BY word")
def flat_map_split(spark: SparkSession, d: str) -> DataFrame:
    words = Stream(table(spark, d, "documents").select("text")).flat_map(F.split("text", " ")).filter(F.col("value") != "")
    return words.df.groupBy(F.col("value").alias("word")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, CAST(props->>'k' AS BIGINT) AS k FROM events")
def flat_map_json_decode(spark: SparkSession, d: str) -> DataFrame:
    return kafka.decode(table(spark, d, "events"), "k bigint", "props", keep=("event_id",))


@query("""SELECT delivery_id, CAST(TRY_CAST(j->>'timestamp' AS BIGINT) AS BIGINT) AS "timestamp" FROM (SELECT delivery_id, TRY_CAST(DECODE(payload) AS JSON) AS j FROM kafka_message WHERE payload IS NOT NULL) WHERE JSON_TYPE(j, '$.timestamp') IN ('UBIGINT', 'BIGINT')""")
def kafka_json_decode(spark: SparkSession, d: str) -> DataFrame:
    """Payloads of stored messages as rows; what is no JSON, or has no whole time, is left out."""
    out = kafka.decode(table(spark, d, "kafka_message").where(F.col("payload").isNotNull()), MODEL, keep=("delivery_id",))
    return out.where(F.col("timestamp").isNotNull()).select("delivery_id", "timestamp")


@query("""SELECT event_id, '{"app":"' || event_type || '","count":' || user_id || '}' AS payload FROM events""")
def flat_map_json_encode(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", scalars.encode_json(F.col("event_type").alias(CHECKPOINT_DATA.names[1]), F.col("user_id").alias(CHECKPOINT_DATA.names[2])).alias("payload"))


@query(f"SELECT event_id AS id, UPPER(event_type) AS kind, cents * 2 AS doubled FROM {_EVENTS}")
def project(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).map(F.col("event_id").alias("id"), F.upper("event_type").alias("kind"), (F.col("cents") * 2).alias("doubled")).df


# -- several streams


@query(f"SELECT t, event_type AS kind, cents FROM {_EVENTS} UNION ALL SELECT t, o_orderstatus, cents FROM {_ORDERS}")
def connect_union(spark: SparkSession, d: str) -> DataFrame:
    left = _events(spark, d).map("t", F.col("event_type").alias("kind"), "cents")
    return left.connect(_orders(spark, d)).process(lambda df: df, lambda i, df: df.select("t", F.col("o_orderstatus").alias("kind"), "cents")).df


@query(f"""SELECT 'left' AS side, CAST(NULL AS INTEGER) AS seq, COUNT(*) AS n FROM {_EVENTS} UNION ALL SELECT 'right', 0, COUNT(*) FROM {_ORDERS} UNION ALL SELECT 'right', 1, COUNT(*) FROM {_LINES}""")
def connect_three_way(spark: SparkSession, d: str) -> DataFrame:
    out = _events(spark, d).connect(_orders(spark, d), _lines(spark, d)).process(
        lambda df: df.select(F.lit("left").alias("side"), F.lit(None).cast("int").alias("seq")), lambda i, df: df.select(F.lit("right").alias("side"), F.lit(i).alias("seq"))
    )
    return out.df.groupBy("side", "seq").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey, c_name, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def connect_broadcast_enrich(spark: SparkSession, d: str) -> DataFrame:
    """Rows enriched from a small configuration stream."""
    config = Stream(table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name"))
    return Stream(table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey")).enrich(config, "c_nationkey").map("c_custkey", "c_name", "n_name").df


@query(_hop_sql(f"(SELECT t, event_type AS kind, cents FROM {_EVENTS} UNION ALL SELECT t, o_orderpriority, cents FROM {_ORDERS})", "kind", _four_sql("cents"), 7 * DAY))
def connect_then_window(spark: SparkSession, d: str) -> DataFrame:
    left = _events(spark, d).map("t", F.col("event_type").alias("kind"), "cents")
    both = left.connect(_orders(spark, d).key_by("o_orderpriority")).process(lambda df: df, lambda i, df: df.select("t", F.col("o_orderpriority").alias("kind"), "cents"))
    return both.key_by("kind").window(windows.tumble(7 * DAY)).reduce(*_four("cents")).df


@query(f"""SELECT event_type AS kind, row_count, window_start FROM ({_hop_sql(_EVENTS, 'event_type', 'COUNT(*) AS row_count', DAY)})
    UNION ALL SELECT 'nation-' || n_name, NULL, NULL FROM nation""")
def reduce_then_connect(spark: SparkSession, d: str) -> DataFrame:
    reduced = _events(spark, d).key_by("event_type").window(windows.tumble(DAY)).reduce(A.count().named("row_count"))
    config = Stream(table(spark, d, "nation"))
    out = reduced.connect(config).process(lambda df: df.select(F.col("event_type").alias("kind"), "row_count", "window_start"), lambda i, df: df.select(F.concat(F.lit("nation-"), "n_name").alias("kind")))
    return out.df


@query(f"""WITH hourly AS ({_hop_sql(_EVENTS, 'event_type, user_id', 'CAST(SUM(cents) AS BIGINT) AS sum_value', HOUR)}),
    again AS (SELECT event_type, sum_value, window_start AS t FROM hourly)
    {_hop_sql('again', 'event_type', 'CAST(MAX(sum_value) AS BIGINT) AS max_value, COUNT(*) AS row_count', DAY)}""")
def reduce_then_reduce(spark: SparkSession, d: str) -> DataFrame:
    """Hourly sums per user, then the busiest per type and day."""
    hourly = _events(spark, d).key_by("event_type", "user_id").window(windows.tumble(HOUR)).reduce(A.sum_("cents").named("sum_value"))
    again = hourly.map("event_type", "sum_value", F.col("window_start").alias("t")).assign_timestamps(bounded(0).with_timestamps("t"))
    return again.key_by("event_type").window(windows.tumble(DAY)).reduce(A.max_("sum_value").named("max_value"), A.count().named("row_count")).df


@query("SELECT row_id FROM stream_table")
def round_robin(spark: SparkSession, d: str) -> DataFrame:
    return Stream(table(spark, d, "stream_table").select("row_id")).round_robin(7).df


@query("SELECT n_nationkey, CAST(c AS INTEGER) AS channel FROM nation, RANGE(0, 4) AS r(c)")
def broadcast_replicate(spark: SparkSession, d: str) -> DataFrame:
    return Stream(table(spark, d, "nation").select("n_nationkey")).replicate(4).df


# -- time, sources, sinks


@query("""WITH marks AS (SELECT job_id, batch_id, MAX("timestamp") AS mark FROM stream_table WHERE "timestamp" IS NOT NULL GROUP BY ALL),
    b AS (SELECT job_id, batch_id, MAX(mark) OVER (PARTITION BY job_id ORDER BY batch_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mark FROM marks)
    SELECT row_id FROM stream_table s JOIN bounded_out_of_orderness_watermarks l ON s.job_id = l.job_id LEFT JOIN b ON s.job_id = b.job_id AND s.batch_id = b.batch_id
    WHERE "timestamp" IS NOT NULL AND (mark IS NULL OR "timestamp" >= mark - out_of_orderness_millis - 1)""")
def watermark_late_drop_model(spark: SparkSession, d: str) -> DataFrame:
    """The strict rule for single records: those older than their job's watermark are dropped; batches are the ticks that publish it."""
    out = late.classify(table(spark, d, "stream_table"), table(spark, d, "bounded_out_of_orderness_watermarks"))
    return out.where((F.col("arrival") != late.UNTIMED) & (F.col("watermark").isNull() | (F.col("timestamp") >= F.col("watermark")))).select("row_id")


@query(_hop_sql(_MODEL, "name", _four_sql("value"), DAY, DAY // 2))
def stream_hop(spark: SparkSession, d: str) -> DataFrame:
    """The same windows on a stream over the table's files in append mode: what the watermark closes, then, at the end of the input, the rest."""
    rows = spark.readStream.schema(table(spark, d, "stream_table").schema).parquet(f"{d}/stream_table.parquet*").select("timestamp", "name", "value")
    last = table(spark, d, "stream_table").agg(F.max("timestamp")).first()[0] or 0

    def build(df: DataFrame) -> DataFrame:
        return Stream(df).assign_timestamps(bounded(1000)).key_by("name").window(windows.hop(DAY, DAY // 2)).reduce(*_four("value")).df

    return runner.run_to_end(rows, build, scratch(spark), ts="timestamp", last=last, delay=1000, size=DAY)


@query("""SELECT row_id, STRFTIME(MAKE_TIMESTAMP("timestamp" * 1000), '%Y-%m-%d %H:%M:%S') AS at, STRFTIME(MAKE_TIMESTAMP("timestamp" * 1000) + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M:%S') AS at_cst, "timestamp" - "timestamp" % 60000 AS minute FROM stream_table""")
def scalar_ms_format(spark: SparkSession, d: str) -> DataFrame:
    ts = F.col("timestamp")
    return table(spark, d, "stream_table").select("row_id", scalars.format_ms(ts).alias("at"), F.date_format(scalars.in_zone(ts), scalars.DATE_TIME).alias("at_cst"), windows.window_start(ts, 0, 60_000).alias("minute"))


@query("""SELECT job_id, name, COUNT(*) FILTER (WHERE window_start <= 1420243200000 AND 1420156800000 <= window_end) AS meeting, MIN(LEAST(window_start, 1420156800000)) AS cover_start, MAX(GREATEST(window_end, 1420243200000)) AS cover_end FROM time_window GROUP BY ALL""")
def window_intersects_cover(spark: SparkSession, d: str) -> DataFrame:
    lo, hi = F.lit(1_420_156_800_000), F.lit(1_420_243_200_000)
    start, end = windows.cover(F.col("window_start"), F.col("window_end"), lo, hi)
    met = windows.intersects(F.col("window_start"), F.col("window_end"), lo, hi)
    return table(spark, d, "time_window").groupBy("job_id", "name").agg(F.count(F.when(met, 1)).alias("meeting"), F.min(start).alias("cover_start"), F.max(end).alias("cover_end"))


_RANGE = kafka.OffsetRange.direct({"floor.pulse": [1500, 4000, 3000]}, {"floor.pulse": [2500, 5000]})


@query("""SELECT delivery_id FROM kafka_message WHERE topic = 'floor.pulse' AND (("partition" = 0 AND "offset" BETWEEN 1500 AND 2500) OR ("partition" = 1 AND "offset" BETWEEN 4000 AND 5000) OR ("partition" = 2 AND "offset" >= 3000))""")
def kafka_replay_direct(spark: SparkSession, d: str) -> DataFrame:
    """Bounded replay by offsets, both ends inclusive, of stored messages."""
    return kafka.replay(table(spark, d, "kafka_message"), kafka.OffsetRange.from_properties(_RANGE.to_properties())).select("delivery_id")


@query("""SELECT delivery_id FROM kafka_message WHERE (topic = 'floor.pulse' AND "timestamp" BETWEEN 1420329600000 AND 1420934400000) OR (topic = 'kiln.temp' AND "timestamp" >= 1420416000000)""")
def kafka_replay_timestamp(spark: SparkSession, d: str) -> DataFrame:
    offsets = kafka.OffsetRange.timestamp({"floor.pulse": 1_420_329_600_000, "kiln.temp": 1_420_416_000_000}, {"floor.pulse": 1_420_934_400_000})
    return kafka.replay(table(spark, d, "kafka_message"), offsets).select("delivery_id")


@query("""SELECT 'out' AS topic, CAST(event_type AS BLOB) AS "key", CAST('{"timestamp":' || (EPOCH_US(ts) // 1000) || ',"name":"' || event_type || '","value":' || user_id || '}' AS BLOB) AS value FROM events""")
def kafka_sink_rows(spark: SparkSession, d: str) -> DataFrame:
    """What the Kafka sink is given: key, value, topic."""
    e = table(spark, d, "events")
    rows = e.select(F.col("event_type").alias("key"), scalars.encode_json(scalars.millis_of(F.col("ts")).alias("timestamp"), F.col("event_type").alias("name"), F.col("user_id").alias("value")).alias("payload"))
    return kafka.writer_columns(rows, "out")


@query(f"""SELECT '[' || STRFTIME(MAKE_TIMESTAMP(window_start * 1000), '%H:%M:%S') || ', ' || STRFTIME(MAKE_TIMESTAMP(window_end * 1000), '%H:%M:%S') || '], ' || event_type || ', ' || row_count AS line
    FROM ({_hop_sql(_EVENTS, 'event_type', 'COUNT(*) AS row_count', 6 * HOUR)})""")
def print_lines(spark: SparkSession, d: str) -> DataFrame:
    out = _events(spark, d).key_by("event_type").window(windows.tumble(6 * HOUR)).reduce(A.count().named("row_count")).df
    return out.select(sinks.print_line(out).alias("line"))
