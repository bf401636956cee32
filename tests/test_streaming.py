"""Streams give what the same query gives over bounded input; stateful processors; corrections that survive restarts."""

import random

import pytest
from pyspark.sql import functions as F

from fixture_model import GOLDEN, ROWS, START
from tidemark import types as tt
from tidemark.functions import aggregates as A
from tidemark.functions import windows
from tidemark.operators import late
from tidemark.operators.incremental import RunStore
from tidemark.plans.stream import Stream
from tidemark.streaming import runner, state
from tidemark.streaming.corrections import CorrectedStream
from tidemark.streaming.watermarks import bounded


LAST = max(t for t, _, _ in ROWS)


def batches(spark, path, parts, schema):
    """A folder of files, one per micro-batch, and the stream over it."""
    for i, p in enumerate(parts):
        df = p if hasattr(p, "toDF") else spark.createDataFrame(p, schema)
        df.coalesce(1).write.parquet(f"{path}/in/b={i:03d}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{path}/in/*")


def test_stream_equals_batch(spark, tmp_path):
    ordered = sorted(ROWS)
    stream = batches(spark, tmp_path, [ordered[:20], ordered[20:], runner.sentinel(spark, tt.MODEL, "timestamp", runner.closing_time(LAST, 1000, 60_000))], tt.MODEL)
    out = Stream(stream).assign_timestamps(bounded(1000)).key_by("name").window(windows.hop(60_000, 20_000)).reduce(A.sum_("value"), A.max_("value"), A.min_("value"), A.count(), A.pct("value", (5, 10, 20)).named("h"))
    got = runner.without_sentinel(runner.drain(out.df, "golden", str(tmp_path / "cp")), LAST).collect()
    assert {(r.name, (r.window_start - START) // 1000): (r["sum(value)"], r["max(value)"], r["min(value)"], r["count"]) for r in got} == {(n, s): v for n in ("A-key-0", "B-key-0", "C-key-0") for s, v in GOLDEN.items()}
    assert all(sum(r.h.values()) == r["count"] for r in got)


def test_record_lateness_by_source(spark, tmp_path):
    rnd = random.Random(0)
    parts = [[(rnd.choice([None, b * 10 + rnd.randint(-30, 10)]), rnd.choice("ab"), i) for i in range(20)] for b in range(4)]
    out = state.mark_late_records(batches(spark, tmp_path, parts, tt.MODEL), ["name"], "timestamp", 5)
    got = sorted((r.name, r.timestamp, r.value, r.late) for r in runner.drain(out, "late").collect())
    expected, marks = [], {"a": (0, 0), "b": (0, 0)}
    for p in parts:
        before = dict(marks)
        for t, n, v in p:
            if t is not None:
                expected.append((n, t, v, t < before[n][1]))
                marks[n] = (max(marks[n][0], t), marks[n][1])
        marks = {n: (m, max(w, m - 6)) if any(x[1] == n for x in p) else (m, w) for n, (m, w) in marks.items()}
    assert got == sorted(expected)


def test_evolving_configuration(spark, tmp_path):
    left = batches(spark, tmp_path / "l", [[(1, "a", 1), (1, "b", 1)], [(2, "a", 2)]], tt.MODEL)
    right = batches(spark, tmp_path / "r", [[("a", "x")], [("a", "y")]], "name string, setting string")
    out = state.enrich_evolving(left, right, "name", "setting")
    runner.drain(out, "conf")
    assert {(r.name, r.value) for r in spark.table("conf").collect()} == {("a", 1), ("b", 1), ("a", 2)}
    assert {r.setting for r in spark.table("conf").where("name = 'b'").collect()} == {None}
    assert {r.setting for r in spark.table("conf").where("name = 'a'").collect()} == {"x", "y"}


def test_custom_fold_on_a_stream(spark, tmp_path):
    stream = batches(spark, tmp_path, [sorted(ROWS)[:20], sorted(ROWS)[20:], runner.sentinel(spark, tt.MODEL, "timestamp", runner.closing_time(LAST, 0, 60_000)).withColumn("name", F.lit("end"))], tt.MODEL)
    s = Stream(stream).assign_timestamps(bounded(0)).key_by("name").window(windows.tumble(60_000))
    out = state.fold_windows(s.assigned(), ["name"], lambda acc, row: {"text": (acc or {"text": ""})["text"] + f"{row['value']},"}, "text string")
    got = {(r.name, r.window_start): sorted(r.text.strip(",").split(","), key=int) for r in runner.without_sentinel(runner.drain(out, "folded"), LAST).collect()}
    expected = {}
    for t, n, v in ROWS:
        expected.setdefault((n, t - t % 60_000), []).append(v)
    assert got == {k: [str(x) for x in sorted(v)] for k, v in expected.items()}


SCHEMA = "timestamp bigint, name string, value bigint, job_id int"
LIMITS = "job_id int, out_of_orderness_millis bigint, window_size_millis bigint, allowed_lateness_millis bigint"


def test_corrected_stream_equals_history(spark, tmp_path):
    rnd = random.Random(5)
    parts = [[(rnd.choice([None, b * 8 + rnd.randint(-40, 8)]) if rnd.random() < 0.1 else b * 8 + rnd.randint(-40, 8), rnd.choice(["a", "b", None]), rnd.choice([None, rnd.randint(-9, 9)]), rnd.choice([1, 2])) for _ in range(25)] for b in range(4)]
    limits = spark.createDataFrame([(1, 5, 10, 20), (2, 0, 7, 3)], LIMITS)
    stream = CorrectedStream(RunStore(spark, str(tmp_path / "store")), limits)
    final, diverted = {}, 0
    for i, p in enumerate(parts):
        df = spark.createDataFrame(p, SCHEMA)
        commit = stream.take(df, i)
        assert stream.take(df, i) is None  # the repeated batch changes nothing
        for r in spark.read.parquet(commit["outputs"]["output"]).collect():
            assert r.correction == ((r.job_id, r.name, r.window_start) in final)
            final[r.job_id, r.name, r.window_start] = (r.sum_value, r.max_value, r.min_value, r.row_count)
        diverted += spark.read.parquet(commit["outputs"]["diverted"]).count()
    for r in stream.flush(9).collect():
        final[r.job_id, r.name, r.window_start] = (r.sum_value, r.max_value, r.min_value, r.row_count)
    whole = spark.createDataFrame([(*x, b) for b, p in enumerate(parts) for x in p], SCHEMA + ", batch_id bigint")
    c = late.classify(whole, limits, keep=("name", "value"))
    expected = {(r.job_id, r.name, r.window_start): (r.final_sum_value, r.final_max_value, r.final_min_value, r.final_row_count) for r in late.corrected_windows(c).collect()}
    assert final == expected
    assert diverted == c.where(F.col("arrival") == late.DIVERTED).count()
