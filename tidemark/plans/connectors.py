"""The registered queries of sources, sinks, scalars, properties and applications, and their SQL."""

from __future__ import annotations

import contextlib
import io
import json
import threading
import uuid
from collections.abc import Iterator
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import app
from tidemark.functions import aggregates as A
from tidemark.functions import histogram, scalars, windows
from tidemark.plans.registry import Registry
from tidemark.plans.stream import Stream
from tidemark.properties import Properties
from tidemark.session import scratch, table
from tidemark.sources import jdbc, kafka, memory, sinks
from tidemark.streaming import runner
from tidemark.streaming.watermarks import bounded
from tidemark.types import SPARK_TYPES, is_numeric

REGISTRY = Registry()
query = REGISTRY.query
DAY = 86_400_000


def _values(rows: list[tuple], names: str) -> str:
    text = lambda v: "NULL" if v is None else str(v).upper() if isinstance(v, bool) else repr(v) if not isinstance(v, str) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)}) AS t({names})"


# -- sources


@query("SELECT CAST(i AS INTEGER) AS id, 'n-' || (i % 7) AS name FROM RANGE(0, 500) AS r(i)")
def source_vec(spark: SparkSession, d: str) -> DataFrame:
    return memory.vec_source(spark, [(i, f"n-{i % 7}") for i in range(500)], "id int, name string", 3)


def _split_rows(split: memory.Split) -> Iterator[tuple]:
    for (i,) in memory.sequence_rows(split, 10_000):
        yield i, split.number, split.properties["tag"]


@query("SELECT i AS id, CAST(i % 3 AS INTEGER) AS split, ['a', 'b', 'c'][i % 3 + 1] AS tag FROM RANGE(0, 10000) AS r(i)")
def source_iterator(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a generator, a call per split, each with its own properties."""
    return memory.iterator_source(spark, _split_rows, "id bigint, split int, tag string", 3, [{"tag": t} for t in "abc"])


def _squares(first: int, beyond: int) -> Iterator[tuple]:
    for i in range(first, beyond):
        yield i, i * i


@query("SELECT i AS id, i * i AS square FROM RANGE(0, 2500) AS r(i)")
def source_generator_stream(spark: SparkSession, d: str) -> DataFrame:
    """A generator as a stream: micro-batches of 1000 numbers in two splits, to the end."""
    stream = memory.generator_stream(spark, _squares, "id bigint, square bigint", 1000, 2, 2500)
    at = scratch(spark)
    q = sinks.file_sink(f"{at}/out", checkpoint=f"{at}/checkpoint", processingTime="0 seconds")(stream)
    _until(q, 2500)
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


def _until(q, rows: int, seconds: float = 120) -> None:
    """Stop a query once it has taken so many rows."""
    import time

    end, seen, last = time.monotonic() + seconds, 0, -1
    while seen < rows and q.isActive and time.monotonic() < end:
        for p in q.recentProgress:
            if p.batchId > last:
                seen, last = seen + p.numInputRows, p.batchId
        time.sleep(0.1)
    q.stop()
    if q.exception():
        raise q.exception()


@query("SELECT CAST(1000 AS BIGINT) AS n, CAST(0 AS BIGINT) AS first, CAST(9990 AS BIGINT) AS last, TRUE AS named, TRUE AS inside")
def source_random(spark: SparkSession, d: str) -> DataFrame:
    """What is sure of random rows: their number, their times, their names and bounds."""
    rows = memory.random_rows(spark, 1000)
    named = F.bool_and(F.col("name") == F.concat(F.lit("name-"), F.col("value")))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"), named.alias("named"), F.bool_and(F.col("value").between(0, 99)).alias("inside"))


@query("SELECT 'c-' || i AS field, CAST(i AS VARCHAR) AS value FROM RANGE(0, 5) AS r(i)")
def source_config(spark: SparkSession, d: str) -> DataFrame:
    return memory.config_source(spark, "c")


@query("SELECT i AS id, i * i AS square FROM RANGE(0, 300) AS r(i)")
def source_daemon(spark: SparkSession, d: str) -> DataFrame:
    """A main stream that ends, beside an endless one that is stopped with it."""
    at = scratch(spark)
    main = memory.generator_stream(spark, _squares, "id bigint, square bigint", 300, 1, 300, name="tidemark_main")
    side = sinks.memory_sink(f"side_{uuid.uuid4().hex}", processingTime="1 second")(memory.config_stream(spark, "c", 1 << 40))
    memory.stop_with(sinks.file_sink(f"{at}/out", checkpoint=f"{at}/checkpoint")(main), side)
    if side.isActive:
        raise RuntimeError("the side stream goes on")
    return spark.read.schema(main.schema).parquet(f"{at}/out")


@query("""SELECT "timestamp", "key", payload, topic, "partition", "offset" FROM kafka_message""")
def kafka_record(spark: SparkSession, d: str) -> DataFrame:
    """Messages built column by column, in the order and with the types of the message schema."""
    m = table(spark, d, "kafka_message")
    return m.select(*kafka.build_record(*(F.col(c).cast("string") if c in ("timestamp", "partition", "offset") else F.col(c) for c in ("timestamp", "key", "payload", "topic", "partition", "offset"))))


_DIRECT = kafka.OffsetRange.direct({"t.a": [121, 71, 78]}, {"t.a": [137, 84, 94]})
_TIMES = kafka.OffsetRange.timestamp({"t": 5, "u": 6}, {"t": 9, "u": 10})
_OPTIONS = [
    ("none", 0, "kafka.bootstrap.servers", "h:9092"), ("none", 0, "startingOffsets", "latest"), ("none", 0, "subscribe", "t,u"),
    ("direct", 0, "kafka.bootstrap.servers", "h:9092"), ("direct", 0, "subscribe", "t.a"),
    ("direct", 0, "startingOffsets", '{"t.a": {"0": 121, "1": 71, "2": 78}}'), ("direct", 0, "endingOffsets", '{"t.a": {"0": 138, "1": 85, "2": 95}}'),
    ("times", 0, "kafka.bootstrap.servers", "h:9092"), ("times", 0, "subscribe", "t"), ("times", 0, "startingTimestamp", "5"), ("times", 0, "endingTimestamp", "10"),
    ("times", 1, "kafka.bootstrap.servers", "h:9092"), ("times", 1, "subscribe", "u"), ("times", 1, "startingTimestamp", "6"), ("times", 1, "endingTimestamp", "11"),
    ("known", 0, "kafka.bootstrap.servers", "h:9092"), ("known", 0, "subscribe", "t,u"),
    ("known", 0, "startingOffsetsByTimestamp", '{"t": {"0": 5, "1": 5}, "u": {"0": 6}}'), ("known", 0, "endingOffsetsByTimestamp", '{"t": {"0": 10, "1": 10}, "u": {"0": 11}}'),
]


@query(_values(_OPTIONS, "kind, reader, option, value"))
def kafka_reader_options(spark: SparkSession, d: str) -> DataFrame:
    """The readers that a Kafka source is made of, for each kind of offset range."""
    conf = {"bootstrap.servers": "h:9092"}
    made = {
        "none": kafka.source_options(conf, ["t", "u"], kafka.OffsetRange(), False), "direct": kafka.source_options(conf, ["t.a"], _DIRECT, True),
        "times": kafka.source_options(conf, ["t", "u"], _TIMES, True), "known": kafka.source_options(conf, ["t", "u"], _TIMES, True, partitions={"t": 2, "u": 1}),
    }
    rows = [(kind, i, k, v) for kind, readers in made.items() for i, options in enumerate(readers) for k, v in options.items()]
    return spark.createDataFrame(rows, "kind string, reader int, option string, value string")


@query(_values([("type", "direct"), ("begin.t.a", "121,71,78"), ("end.t.a", "137,84,94")], '"key", value'))
def kafka_range_properties(spark: SparkSession, d: str) -> DataFrame:
    """An offset range as properties, there and back and there again."""
    again = kafka.OffsetRange.from_properties(_DIRECT.to_properties())
    return spark.createDataFrame(list(again.to_properties().values.items()), "key string, value string")


# -- sinks


@query("SELECT CAST(n_nationkey AS VARCHAR) || ', ' || n_name AS line FROM nation")
def sink_print(spark: SparkSession, d: str) -> DataFrame:
    """What the print sink prints of a table, but for its header."""
    out = io.StringIO()
    rows = table(spark, d, "nation").select("n_nationkey", "n_name")
    with contextlib.redirect_stdout(out):
        sinks.print_sink()(rows)
    return spark.createDataFrame([(x,) for x in out.getvalue().splitlines()[1:]], "line string")


@query("SELECT row_id, job_id, name, value FROM stream_table")
def sink_file(spark: SparkSession, d: str) -> DataFrame:
    at = scratch(spark)
    sinks.file_sink(at, partition_by=["job_id"])(table(spark, d, "stream_table").select("row_id", "name", "value", "job_id"))
    return spark.read.parquet(at)


@query("SELECT row_id, name, value FROM stream_table")
def sink_file_stream(spark: SparkSession, d: str) -> DataFrame:
    """A stream to files, started twice on one checkpoint: each row is there once."""
    at, schema = scratch(spark), table(spark, d, "stream_table").schema
    stream = spark.readStream.schema(schema).parquet(f"{d}/stream_table.parquet*").select("row_id", "name", "value")
    for _ in range(2):
        sinks.file_sink(f"{at}/out", checkpoint=f"{at}/checkpoint", name=f"files_{uuid.uuid4().hex}")(stream).awaitTermination()
    return spark.read.parquet(f"{at}/out")


@query("SELECT event_id, event_type FROM events")
def sink_memory(spark: SparkSession, d: str) -> DataFrame:
    name = f"memory_{uuid.uuid4().hex}"
    sinks.memory_sink(name)(table(spark, d, "events").select("event_id", "event_type"))
    return spark.table(name)


@query("SELECT s_suppkey, s_name FROM supplier")
def sink_jdbc(spark: SparkSession, d: str) -> DataFrame:
    """Rows to two databases in memory, and read back from both. The databases live in the driver's JVM; on a cluster,
    where the rows that are read back are copied, they are dropped then."""
    rows = table(spark, d, "supplier").select(F.col("s_suppkey").cast("bigint").alias("s_suppkey"), "s_name")
    urls = [f"jdbc:derby:memory:t{uuid.uuid4().hex};create=true" for _ in range(2)]
    options = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    sinks.jdbc_sink(urls, "suppliers", embedded=True, **options)(rows)
    back = [jdbc.jdbc_source(spark, u, "suppliers", embedded=True, **options) for u in urls]
    if not jdbc.in_driver(spark):
        for u in urls:
            _drop_derby(spark, u)
    return back[0].unionByName(back[1]).toDF("s_suppkey", "s_name").withColumn("s_suppkey", F.col("s_suppkey").cast(table(spark, d, "supplier").schema["s_suppkey"].dataType))


def _drop_derby(spark: SparkSession, url: str) -> None:
    """Drop a Derby database in memory, which Derby confirms by an error."""
    try:
        spark._jvm.java.sql.DriverManager.getConnection(url.replace(";create=true", ";drop=true"))
    except Py4JJavaError as e:
        if e.java_exception.getSQLState() != "08006":
            raise


@query("SELECT 'suppliers' AS index, s_suppkey AS id, s_name AS name FROM supplier")
def sink_bulk(spark: SparkSession, d: str) -> DataFrame:
    """What a server gets from the bulk sink, in requests of at most 50 documents, the last one of an id counting."""
    got: dict[int, tuple] = {}

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self) -> None:
            lines = self.rfile.read(int(self.headers["Content-Length"])).decode().strip().split("\n")
            for action, document in zip(lines[::2], lines[1::2]):
                a, x = json.loads(action)["index"], json.loads(document)
                got[a["_id"]] = (a["_index"], a["_id"], x["name"])
            self.send_response(200)
            self.end_headers()
            self.wfile.write(b'{"errors": false}')

        def log_message(self, *_) -> None:
            pass

    host = spark.conf.get("spark.driver.host", "127.0.0.1")
    server = ThreadingHTTPServer((host, 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        rows = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
        sinks.bulk_sink(f"http://{host}:{server.server_port}", "suppliers", batch=50, id_column="id")(rows)
    finally:
        server.shutdown()
    kind = table(spark, d, "supplier").schema["s_suppkey"].dataType.simpleString()
    return spark.createDataFrame(list(got.values()), f"index string, id {kind}, name string")


class _Lines(sinks.OutputFormat):
    """Writes each task's rows to a file of its own."""

    def __init__(self, folder: str):
        self.folder = folder

    def open(self, task: int) -> None:
        self.file = (Path(self.folder) / f"{task}-{uuid.uuid4().hex}.json").open("w")

    def write(self, row: Row) -> None:
        self.file.write(json.dumps(row.asDict()) + "\n")

    def close(self, error: Exception | None) -> None:
        self.file.close()


@query("SELECT c_custkey AS custkey, c_name AS name FROM customer")
def sink_format(spark: SparkSession, d: str) -> DataFrame:
    """A sink of one's own, opened and closed once a task, that writes files to the shared folder."""
    folder = scratch(spark).removeprefix("file:")
    Path(folder).mkdir(parents=True)
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("custkey"), F.col("c_name").alias("name"))
    sinks.format_sink(lambda: _Lines(folder))(rows)
    return spark.read.schema(rows.schema).json(folder)


# -- scalars, aggregates, keys


@query("""SELECT row_id, STRFTIME(MAKE_TIMESTAMP("timestamp" * 1000), '%Y-%m-%dT%H:%M:%S.%g') || '(' || "timestamp" || ')' AS at FROM stream_table""")
def scalar_timestamp_str(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "stream_table").select("row_id", scalars.timestamp_str(F.col("timestamp")).alias("at"))


@query("SELECT TRUE AS same, TRUE AS now")
def scalar_now(spark: SparkSession, d: str) -> DataFrame:
    """The present in seconds and in milliseconds: the same moment, and within an hour of this process's clock."""
    import time

    ms, s = scalars.current_timestamp_millis(), scalars.current_timestamp()
    return spark.range(1).select((F.floor(ms / 1000) == s).alias("same"), (F.abs(s - int(time.time())) < 3600).alias("now"))


@query("SELECT COUNT(DISTINCT n_name) AS names, TRUE AS told_apart, TRUE AS repeated FROM nation")
def scalar_hash_code(spark: SparkSession, d: str) -> DataFrame:
    """Hashes tell the names apart, and are the same when they are computed again."""
    h = scalars.hash_code(F.col("n_name"))
    rows = table(spark, d, "nation").select("n_name", h.alias("h")).withColumn("again", scalars.hash_code(F.concat("n_name", F.lit(""))))
    return rows.agg(F.count_distinct("n_name").alias("names"), (F.count_distinct("h") == F.count_distinct("n_name")).alias("told_apart"), F.bool_and(F.col("h") == F.col("again")).alias("repeated"))


@query(_values([(n, n not in ("boolean", "binary", "string")) for n in SPARK_TYPES], "type, accepted"))
def agg_type_check(spark: SparkSession, d: str) -> DataFrame:
    """Which column types a sum takes: checked when the query is declared."""
    rows = []
    for name, kind in SPARK_TYPES.items():
        try:
            A.sum_("v").check(T.StructType([T.StructField("v", kind)]))
            rows.append((name, is_numeric(kind)))
        except TypeError:
            rows.append((name, False))
    return spark.createDataFrame(rows, "type string, accepted boolean")


_BOUNDS = [float(x) for x in histogram.SCALE_345]


@query(f"""WITH b AS (SELECT event_type, LEAST(LEN(LIST_FILTER({_BOUNDS}, lambda x: x < value)), {len(_BOUNDS) - 1}) AS bucket FROM events WHERE value IS NOT NULL)
    SELECT event_type, CAST(bucket AS INTEGER) AS bucket, COUNT(*) AS n FROM b GROUP BY ALL""")
def hist_merge(spark: SparkSession, d: str) -> DataFrame:
    """Daily histograms as arrays of counts, merged to one per type."""
    n = len(_BOUNDS)
    b = histogram.bucket_small(F.col("value"), histogram.SCALE_345)
    each = table(spark, d, "events").select("event_type", F.to_date("ts").alias("day"), b.alias("bucket")).where(F.col("bucket").isNotNull())
    daily = each.groupBy("event_type", "day", "bucket").agg(F.count(F.lit(1)).alias("n")).groupBy("event_type", "day").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "n"))).alias("m"))
    zero = F.lit(0).cast("bigint")
    arrays = daily.select("event_type", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce(F.element_at("m", i), zero)).alias("counts"))
    merged = arrays.groupBy("event_type").agg(F.aggregate(F.collect_list("counts"), F.array_repeat(zero, n), histogram.merge).alias("counts"))
    return merged.select("event_type", F.posexplode("counts").alias("bucket", "n")).where(F.col("n") > 0)


@query(f"""SELECT CASE WHEN name <> '' THEN 9007199254740992 + job_id END AS k, CAST(COUNT(*) AS BIGINT) AS n, CAST(COUNT(value) AS BIGINT) AS present, CAST(BIT_XOR(COALESCE(value, 0)) AS BIGINT) AS mixed,
    "timestamp" - "timestamp" % {DAY} AS window_start, "timestamp" - "timestamp" % {DAY} + {DAY} AS window_end FROM stream_table WHERE "timestamp" >= 0 GROUP BY ALL""")
def custom_fold_nulls(spark: SparkSession, d: str) -> DataFrame:
    """A custom fold keyed by a LONG that can be null and that no double holds, over values with nulls and extremes."""

    def step(acc: dict | None, row: dict) -> dict:
        acc, v = acc or {"n": 0, "present": 0, "mixed": 0}, row["value"]
        return {"n": acc["n"] + 1, "present": acc["present"] + (v is not None), "mixed": acc["mixed"] ^ (v or 0)}

    def merge(a: dict, b: dict) -> dict:
        return {"n": a["n"] + b["n"], "present": a["present"] + b["present"], "mixed": a["mixed"] ^ b["mixed"]}

    key = F.when(F.col("name") != "", F.lit(1 << 53) + F.col("job_id"))
    rows = Stream(table(spark, d, "stream_table").select("timestamp", "name", "job_id", "value")).assign_timestamps(bounded(0).with_timestamps("timestamp"))
    return rows.key_by(k=key).window(windows.tumble(DAY)).fold(step, merge, "n bigint, present bigint, mixed bigint").df


@query(f"""SELECT user_id % 10 AS last_digit, COUNT(*) AS row_count, (EPOCH_US(ts) // 1000) - (EPOCH_US(ts) // 1000) % {DAY} AS window_start, (EPOCH_US(ts) // 1000) - (EPOCH_US(ts) // 1000) % {DAY} + {DAY} AS window_end FROM events GROUP BY ALL""")
def key_by_computed(spark: SparkSession, d: str) -> DataFrame:
    """A computed key, and an event time that an expression assigns."""
    rows = Stream(table(spark, d, "events").select("user_id", "ts")).assign_timestamps(bounded(0).with_assigner(scalars.millis_of(F.col("ts")), "at"))
    return rows.key_by(last_digit=F.col("user_id") % 10).window(windows.tumble(DAY)).reduce(A.count().named("row_count")).df


@query("SELECT CAST(7 AS BIGINT) AS partitions, TRUE AS even FROM (SELECT 1)")
def round_robin_even(spark: SparkSession, d: str) -> DataFrame:
    """Rows dealt over seven partitions: each source task deals evenly, so the partitions differ by a row per task at most."""
    rows = table(spark, d, "stream_table").select("row_id")
    per = Stream(rows).round_robin(7).df.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.count(F.lit(1)).alias("partitions"), (F.max("n") - F.min("n") <= rows.rdd.getNumPartitions()).alias("even"))


# -- properties and applications


@query(_values([("a.b", "1"), ("sub.c", "x"), ("sub.c.d", "true"), ("duration", "2000"), ("scoped", "121,71,78"), ("typed", "1.5")], '"key", value'))
def properties_typed(spark: SparkSession, d: str) -> DataFrame:
    """Properties set and read by type, below a prefix, and scoped to a function, whose own offset range they give."""
    p = Properties().set("a.b", 1).set("a.b.c", "x").set("a.b.c.d", True).set("wait", 2000).set("rate", 1.5)
    p.extend_scope("source", "messages", _DIRECT.to_properties())
    sub = p.sub("a.b")
    scoped = kafka.OffsetRange.from_properties(p.scope("source", "messages"))
    rows = [
        ("a.b", str(p.get_int("a.b"))), ("sub.c", sub.get("c")), ("sub.c.d", str(sub.get_bool("c.d")).lower()), ("duration", str(round(p.get_duration("wait").total_seconds() * 1000))),
        ("scoped", ",".join(map(str, scoped.begin["t.a"]))), ("typed", str(p.get_float("rate"))),
    ]
    return spark.createDataFrame(rows, "key string, value string")


class _Busy(app.StreamApp):
    """Counts per key over windows whose size is a property."""

    def prepare_properties(self, properties: Properties) -> None:
        properties.application_name = "busy"
        properties.set("window.size", DAY)

    def build_stream(self, spark: SparkSession, properties: Properties) -> DataFrame:
        rows = Stream(table(spark, properties.get("data"), "events").select("event_type", "ts")).assign_timestamps(bounded(0).with_timestamps("ts"))
        counts = rows.key_by("event_type").window(windows.tumble(properties.get_int("window.size"))).reduce(A.count().named("row_count"))
        return counts.df.withColumn("app", F.lit(properties.application_name))


@query(f"""SELECT 'busy' AS app, event_type, COUNT(*) AS row_count, (EPOCH_US(ts) // 1000) - (EPOCH_US(ts) // 1000) % {DAY // 2} AS window_start, (EPOCH_US(ts) // 1000) - (EPOCH_US(ts) // 1000) % {DAY // 2} + {DAY // 2} AS window_end FROM events GROUP BY ALL""")
def app_run(spark: SparkSession, d: str) -> DataFrame:
    """An application with its defaults, one of which an argument replaces."""
    return app.execute(_Busy(), [f"window.size={DAY // 2}", "--data", d], spark)
