"""No row is lost to a bound, and what is not supported is refused."""

import pytest
from pyspark.sql import functions as F

from tidemark import session
from tidemark.functions import windows
from tidemark.operators import late, rolling
from tidemark.plans.stream import Stream
from tidemark.sources import kafka, memory, sinks
from tidemark.streaming import runner, state
from tidemark.streaming.watermarks import IDLE, RowWatermark, WatermarkGenerator, bounded, generated

DAY = 86_400_000


def test_rows_without_a_day_come_out(spark):
    d = [("a", None, 1), ("a", 2**62, 2), ("b", -(2**62), None), ("b", -1, 3), (None, 0, 4), ("b", -DAY, 5)]
    df = spark.createDataFrame(d, "name string, timestamp bigint, value bigint")
    got = sorted((r.name, r.reason, r.rows, r.n, r.total) for r in rolling.undated(df).collect())
    assert got == [("a", "out of range", 1, 1, 2), ("a", "untimed", 1, 1, 1), ("b", "out of range", 1, 0, None)]
    assert {(r.name, str(r.day), r.rows_today) for r in rolling.rolling_totals(df).collect()} == {("b", "1969-12-31", 2), (None, "1970-01-01", 1)}
    assert rolling.undated(df.limit(0)).count() == 0


def test_broadcasts_are_bounded_in_rows_and_bytes(spark):
    df = spark.range(10).select(F.repeat(F.lit("x"), 1000).alias("text"), "id")
    hinted = lambda x: "ResolvedHint" in x._jdf.queryExecution().analyzed().toString()
    assert hinted(session.broadcast_within(df, 10)) and not hinted(session.broadcast_within(df, 9))
    assert not hinted(session.broadcast_within(df, 10, 9_000)) and hinted(session.broadcast_within(df.limit(0), 0))


def test_a_cluster_needs_a_shared_folder():
    class No:
        def __getattr__(self, _):
            return self

        def __call__(self, *_):
            return self

    class Context(No):
        master = "spark://x:7077"

        class _jsc:  # noqa: N801
            @staticmethod
            def sc():
                return type("S", (), {"getCheckpointDir": staticmethod(lambda: type("O", (), {"isEmpty": staticmethod(lambda: True)}))})

        @staticmethod
        def getConf():
            return {}

    class Session:
        sparkContext = Context()  # noqa: N815
        conf = {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())


@pytest.mark.parametrize("start", [0, 7_258_118_400_000, 32_503_680_000_000])  # 1970, 2200, 3000
def test_the_end_of_input_is_after_the_last_row(spark, tmp_path, start):
    rows = [(start + t, "a", t) for t in (0, 5, 12, 31)]
    spark.createDataFrame(rows, "timestamp bigint, name string, value bigint").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("timestamp bigint, name string, value bigint").parquet(str(tmp_path / "in"))
    from tidemark.functions import aggregates as A

    build = lambda df: Stream(df).assign_timestamps(bounded(3)).key_by("name").window(windows.hop(20, 10)).reduce(A.count()).df
    out = runner.run_to_end(stream, build, str(tmp_path / "w"), ts="timestamp", last=start + 31, delay=3, size=20)
    want = {s: sum(s <= t < s + 20 for t, _, _ in rows) for s in range(start - 10, start + 40, 10)}
    assert {r.window_start: r["count"] for r in out.collect()} == {s: n for s, n in want.items() if n and s >= 0}


def test_row_rules_of_a_stream_need_sources(spark, tmp_path):
    spark.createDataFrame([], "timestamp bigint").write.parquet(str(tmp_path / "in"))
    stream = Stream(spark.readStream.schema("timestamp bigint").parquet(str(tmp_path / "in")))
    for s in (bounded(1).wrap_idleness(5), bounded(1).wrap_time_periodic(1, 1), generated(WatermarkGenerator)):
        with pytest.raises(ValueError, match="sources"):
            stream.assign_timestamps(s)
    with pytest.raises(ValueError):
        state.strict(stream.df, bounded(1), [])


def test_strict_lateness_of_bounded_rows(spark):
    d = [(i, t, s, b) for i, (t, s, b) in enumerate([(10, "x", 0), (3, "x", 0), (4, "x", 1), (None, "x", 1), (9, "x", 1), (1, None, 1), (50, None, 1), (2, None, 2)])]
    df = spark.createDataFrame(d, "i int, timestamp bigint, s string, b int").repartition(3)
    got = {r.i: (r.watermark, r.late) for r in state.strict(df, bounded(0), ["s"], order=["i"], tick="b").collect()}
    assert got == {0: (0, False), 1: (0, False), 2: (9, True), 4: (9, False), 5: (0, False), 6: (0, False), 7: (49, True)}
    assert state.strict(df.limit(0), bounded(0), ["s"]).count() == 0


def test_generators_keep_their_state_between_batches():
    w = RowWatermark(bounded(5).wrap_time_periodic(10, 20).wrap_idleness(100), now=0)
    w.row(50, 0)
    again = RowWatermark(bounded(5).wrap_time_periodic(10, 20).wrap_idleness(100), now=0).restore(w.snapshot())
    assert again.row(80, 5) and again.watermark == 74 and not again.row(73, 5)
    assert again.tick(50) == 74 and again.tick(106) == IDLE

    class Silent(WatermarkGenerator):
        pass

    s = RowWatermark(generated(Silent))
    assert s.row(5, 0) and s.tick(1) == 0 and s.row(1, 2)


def test_sparse_batch_ids_cost_nothing(spark):
    rows = spark.createDataFrame([(1, t, b, 10 * b) for t in (0, 1) for b in (0, 3_000_000)] + [(1, 0, 10**12, 5)], "job_id int, task int, batch_id bigint, timestamp bigint")
    spec = late.LateSpec(sources=("task",))
    low = late.low_watermarks(late.punctuations(rows, spec), spec)
    assert sorted(map(tuple, low.select("job_id", "batch_id", "mark").collect())) == [(1, 3_000_000, 0), (1, 10**12, 30_000_000)]


def test_expected_sources(spark):
    rows = spark.createDataFrame([(1, 0, 0, 10), (1, 1, 1, 9), (1, 0, 2, 50), (1, 1, 3, 60)], "job_id int, task int, batch_id bigint, timestamp bigint")
    for monotone in (False, True):
        spec = late.LateSpec(sources=("task",), expected=2, monotone=monotone)
        got = sorted(map(tuple, late.low_watermarks(late.punctuations(rows, spec), spec).select("batch_id", "mark").collect()))
        assert got == [(2, 9), (3, 9)]


def test_topics_with_times_of_their_own():
    times = kafka.OffsetRange.timestamp({"t": 5, "u": 6})
    assert [o["subscribe"] for o in kafka.source_options({}, ["t", "u"], times, False)] == ["t", "u"]
    with pytest.raises(ValueError, match="begin time"):
        kafka.source_options({}, ["t", "v"], times, False)


def test_lines_of_odd_rows(spark, capsys, monkeypatch):
    df = spark.createDataFrame([(1, bytearray(b"\xff\x01"))], "a int, b binary")
    assert df.select(sinks.print_line(df)).first()[0] == "1, 0xFF01"
    sinks.print_sink(task=True)(spark.range(3).coalesce(1))
    assert capsys.readouterr().out.splitlines() == ["task, id", "0, 0", "0, 1", "0, 2"]
    monkeypatch.setattr(sinks, "HEADER_AFTER", -1.0)
    sinks.print_sink()(spark.range(2).coalesce(1))
    assert capsys.readouterr().out.splitlines().count("id") == 3


def test_a_format_is_closed_when_a_row_fails(spark, tmp_path):
    at = str(tmp_path)

    class Bad(sinks.OutputFormat):
        def open(self, task):
            self.task = task

        def write(self, row):
            raise ValueError("no")

        def close(self, error):
            open(f"{at}/{self.task}", "w").write(str(error))

    with pytest.raises(Exception, match="no"):
        sinks.format_sink(Bad)(spark.range(1).coalesce(1))
    assert (tmp_path / "0").read_text() == "no"


def test_keys_and_processes_refuse_what_is_not_there(spark):
    s = Stream(spark.createDataFrame([(1, 2)], "a int, b int"))
    with pytest.raises(ValueError, match="exist"):
        s.key_by(a=F.col("b"))
    with pytest.raises(ValueError, match="order"):
        s.connect(s).stateful(["a"], state.CoProcess, "a int", ["nope"])
    assert memory.random_rows(spark, 0).count() == 0


def test_three_inputs_with_state(spark):
    class Count(state.CoProcess):
        """Counts the rows of each input per key; opened before the first one."""

        def open(self):
            self.opened = True

        def left(self, row, state):
            state["n"] = state.get("n", 0) + 1
            yield {"k": row["k"], "n": state["n"], "r": state.get("r", 0)}

        def right(self, number, row, state):
            assert self.opened
            state["r"] = state.get("r", 0) + number + 1
            return ()

    df = lambda rows: Stream(spark.createDataFrame(rows, "k string, at int, extra int"))
    out = df([("a", 2, 1), (None, 1, 1), ("a", 5, 1)]).connect(df([("a", 1, 0)]), df([("a", 3, 0), ("b", 1, 0)])).stateful(["k"], Count, "k string, n int, r int", ["at"])
    assert sorted(map(str, (tuple(r) for r in out.df.collect()))) == sorted(map(str, [("a", 1, 1), ("a", 2, 3), (None, 1, 0)]))
    empty = df([]).connect(df([])).stateful(["k"], Count, "k string, n int, r int")
    assert empty.df.count() == 0
