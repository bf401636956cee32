"""Sources, sinks, properties, applications."""

import json
import threading
from datetime import timedelta
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from tidemark import app
from tidemark.properties import Properties
from tidemark.sources import kafka, memory, sinks


def test_vec_and_iterator_sources(spark):
    assert memory.vec_source(spark, [(1,), (2,), (3,)], "a int", 3).rdd.getNumPartitions() == 3
    assert memory.vec_source(spark, [], "a int").count() == 0

    def rows(split):
        for i in range(split.number, 10, split.of):
            yield (i, split.properties.get("tag", ""))

    out = memory.iterator_source(spark, rows, "i int, tag string", 3, [{"tag": "x"}, {}, {}])
    assert sorted(r.i for r in out.collect()) == list(range(10)) and {r.tag for r in out.collect()} == {"x", ""}
    with pytest.raises(ValueError):
        memory.iterator_source(spark, rows, "i int, tag string", 3, [{}])
    assert [tuple(r) for r in memory.config_source(spark, "c", 2).collect()] == [("c-0", "0"), ("c-1", "1")]
    assert memory.random_stream(spark).isStreaming


def test_offset_ranges_round_trip():
    for r in (kafka.OffsetRange(), kafka.OffsetRange.direct({"t.a": [121, 71, 78]}, {"t.a": [137, 84, 94]}), kafka.OffsetRange.direct({"t": [1]}), kafka.OffsetRange.timestamp({"t": 5, "u": 6}, {"t": 9})):
        assert kafka.OffsetRange.from_properties(r.to_properties()) == r
    p = kafka.OffsetRange.direct({"t": [121, 71]}, {"t": [137, 84]}).to_properties()
    assert p.values == {"type": "direct", "begin.t": "121,71", "end.t": "137,84"}
    with pytest.raises(ValueError):
        kafka.OffsetRange.from_properties(Properties({"type": "odd"}))


def test_reader_options():
    r = kafka.OffsetRange.direct({"t": [121, 71]}, {"t": [137, 84]})
    assert json.loads(r.reader_options(True)["endingOffsets"]) == {"t": {"0": 138, "1": 85}}  # exclusive there
    assert "endingOffsets" not in r.reader_options(False)
    assert kafka.OffsetRange().reader_options(False) == {"startingOffsets": "latest"}
    t = kafka.OffsetRange.timestamp({"t": 5, "u": 6}, {"t": 9, "u": 9})
    assert json.loads(t.timestamp_options({"t": 2, "u": 1}, True)["endingOffsetsByTimestamp"]) == {"t": {"0": 10, "1": 10}, "u": {"0": 10}}


def test_missing_connector_says_so(spark):
    with pytest.raises(RuntimeError, match="spark-sql-kafka"):
        kafka.kafka_source(spark, {"bootstrap.servers": "x:1"}, ["t"])
    with pytest.raises(RuntimeError, match="spark-sql-kafka"):
        sinks.kafka_sink({"bootstrap.servers": "x:1"}, "t")(spark.createDataFrame([("k", "p")], "key string, payload string"))
    with pytest.raises(ValueError):
        kafka.writer_columns(spark.range(1), "t")


def test_replay(spark):
    d = [(1, "t", 0, 5), (2, "t", 0, 6), (3, "t", 1, 1), (4, "u", 0, 5), (5, None, 0, 5), (6, "t", None, 5), (7, "t", 0, None)]
    df = spark.createDataFrame(d, "timestamp bigint, topic string, partition int, offset bigint")
    ids = lambda r: sorted(x.timestamp for x in kafka.replay(df, r).collect())
    assert ids(kafka.OffsetRange.direct({"t": [5, 1]}, {"t": [5]})) == [1, 3]
    assert ids(kafka.OffsetRange.timestamp({"t": 2}, {"t": 6})) == [2, 3, 6]
    assert len(ids(kafka.OffsetRange())) == 7


def test_print_lines(spark):
    df = spark.createDataFrame([(0, 60_000, "a", 1, bytearray(b"xy")), (0, 1, None, None, None)], "window_start bigint, window_end bigint, k string, v int, b binary")
    assert [r[0] for r in df.select(sinks.print_line(df)).collect()] == ["[00:00:00, 00:01:00], a, 1, xy", "[00:00:00, 00:00:00], null, null, null"]


def test_file_and_memory_sinks(spark, tmp_path):
    df = spark.range(5)
    sinks.file_sink(str(tmp_path / "a"))(df)
    assert spark.read.parquet(str(tmp_path / "a")).count() == 5
    stream = spark.readStream.schema("id bigint").parquet(str(tmp_path / "a"))
    with pytest.raises(ValueError):
        sinks.file_sink(str(tmp_path / "b"))(stream)
    for _ in range(2):  # the second run finds nothing new
        sinks.file_sink(str(tmp_path / "b"), checkpoint=str(tmp_path / "cp"))(stream).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "b")).count() == 5
    sinks.memory_sink("mem")(stream).awaitTermination()
    assert spark.table("mem").count() == 5


def test_bulk_sink(spark):
    got, answer = [], {"errors": False}

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            got.append((self.path, self.headers.get("stoken"), self.rfile.read(int(self.headers["Content-Length"])).decode()))
            body = json.dumps(answer).encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    sink = sinks.bulk_sink(f"http://127.0.0.1:{server.server_port}", "idx", headers={"stoken": "s"}, batch=2, id_column="id")
    sink(spark.range(5).coalesce(1).withColumn("t", F.lit("é")))
    assert [x[0] for x in got] == ["/_bulk"] * 3 and got[0][1] == "s"
    lines = [json.loads(x) for _, _, b in got for x in b.strip().split("\n")]
    assert lines[::2] == [{"index": {"_index": "idx", "_id": i}} for i in range(5)] and lines[1] == {"id": 0, "t": "é"}
    answer["errors"] = True
    with pytest.raises(Exception, match="errors"):
        sink(spark.range(1))
    server.shutdown()


def test_jdbc_sink_refuses_no_url():
    with pytest.raises(ValueError):
        sinks.jdbc_sink([], "t")


def test_properties():
    p = Properties().set("a.b", 1).set("a.b.c", "x").set("a.b.c.d", True).set("t", timedelta(seconds=2))
    assert p.sub("a.b").values == {"c": "x", "c.d": "true"}
    assert p.get_duration("t") == timedelta(seconds=2) and p.get_int("a.b") == 1 and p.get_bool("a.b.c.d")
    with pytest.raises(KeyError):
        p.get("none")
    with pytest.raises(ValueError):
        p.get_bool("a.b.c")
    q = Properties().extend_scope("source", "k", kafka.OffsetRange.direct({"t": [1]}).to_properties())
    assert q.scope("source", "k").get("begin.t") == "1"
    with pytest.raises(ValueError):
        q.scope("nothing", "k")
    p.application_name = "one"
    with pytest.raises(ValueError):
        p.application_name = "two"


def test_app(spark):
    class Count(app.StreamApp):
        def prepare_properties(self, properties):
            properties.set("n", 3)

        def build_stream(self, spark, properties):
            return spark.range(properties.get_int("n")).count()

    assert app.execute(Count(), [], spark) == 3 and app.execute(Count(), ["n=7"], spark) == 7 and app.execute(Count(), ["--n", "8"], spark) == 8
    with pytest.raises(ValueError):
        app.parse_args(["odd"])
