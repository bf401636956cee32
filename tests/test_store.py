"""Runs that commit output and state together: what they read, and what is left when one is killed."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidemark.operators import dedup, incremental
from tidemark.operators.late import LateSpec
from tidemark.streaming.corrections import CorrectedStream, MarkedStream

NUMBERS = "space string, n bigint"


def numbers(spark, space, first, beyond):
    return spark.range(first, beyond).select(F.lit(space).alias("space"), F.col("id").alias("n"))


def size(paths):
    return sum(f.stat().st_size for p in paths for f in Path(p.removeprefix("file:")).rglob("*.parquet"))


@pytest.mark.parametrize("appended", [False, True])
def test_a_small_run_reads_and_writes_a_small_share(spark, tmp_path, monkeypatch, appended):
    store = incremental.RunStore(spark, str(tmp_path), bucket_bits=8)
    base = numbers(spark, "a", 0, 600_000).union(numbers(spark, "b", 0, 600_000))
    one = incremental.run_numbered(store, base, ("space",), "n", lambda fresh: fresh)
    assert store.output(commit=one).count() == 1_200_000
    new, read, state = numbers(spark, "a", 600_000, 606_000), [], incremental.RunStore.state

    def spy(self, name="state", buckets=None, commit=None):
        if name == "words":
            read.extend(commit["parts"]["words"][str(b)] for b in buckets if str(b) in commit["parts"]["words"])
        return state(self, name, buckets, commit)

    monkeypatch.setattr(incremental.RunStore, "state", spy)
    run = incremental.run_appended if appended else incremental.run_numbered
    two = run(store, new if appended else base.union(new), ("space",), "n", lambda fresh: fresh)
    assert [r.n for r in store.output(commit=two).orderBy("n").collect()] == list(range(600_000, 606_000))
    words = [one["parts"]["words"], two["parts"]["words"]]
    assert size(read) <= 0.05 * size(words[0].values())  # half a percent of the records are new
    assert sum(words[0].get(b) != p for b, p in words[1].items()) <= 4
    three = incremental.run_numbered(store, base.union(new), ("space",), "n", lambda fresh: fresh)
    assert store.output(commit=three).count() == 0 and three["parts"]["words"] == words[1]


def test_a_killed_run_neither_skips_nor_repeats(spark, tmp_path, monkeypatch):
    store = incremental.RunStore(spark, str(tmp_path))
    got, rename = [], incremental.RunStore._rename_new

    def run(rows):
        commit = incremental.run_appended(store, rows, ("space",), "n", lambda fresh: fresh)
        got.extend(r.n for r in store.output(commit=commit).collect())

    run(numbers(spark, "a", 0, 100))

    def killed(*_):
        raise RuntimeError("killed")

    monkeypatch.setattr(incremental.RunStore, "_rename_new", killed)  # all is written but the commit
    with pytest.raises(Exception, match="killed"):
        run(numbers(spark, "a", 90, 250))
    monkeypatch.setattr(incremental.RunStore, "_rename_new", rename)
    run(numbers(spark, "a", 90, 250))
    run(numbers(spark, None, 0, 3))
    assert sorted(got) == sorted([*range(250), 0, 1, 2])


def test_old_state_goes_and_outputs_stay(spark, tmp_path):
    store = incremental.RunStore(spark, str(tmp_path))
    commits = [incremental.run_appended(store, numbers(spark, "a", i * 10, i * 10 + 10), ("space",), "n", lambda fresh: fresh) for i in range(5)]
    assert all(Path(c["outputs"]["output"]).exists() for c in commits)
    assert [Path(c["parts"]["tree"]).exists() for c in commits] == [False, False, False, True, True]
    assert store.state("words").agg(F.sum(F.bit_count("bits"))).first()[0] == 50
    assert incremental.run_numbered(store, numbers(spark, "a", 0, 0), ("space",), "n", lambda fresh: fresh)["run"] == 6  # nothing at all


DELIVERIES = "id bigint, topic string, part int, seq bigint, body string"


def test_killed_deliveries(spark, tmp_path, monkeypatch):
    store, rename, got = incremental.RunStore(spark, str(tmp_path)), incremental.RunStore._rename_new, []
    key = F.concat_ws("|", F.coalesce("topic", F.lit("?")), F.coalesce(F.col("part").cast("string"), F.lit("?")), F.coalesce(F.col("seq").cast("string"), F.lit("?")), "body")
    parts = [
        [(1, "t", 0, 5, "a"), (2, "t", 0, 5, "a"), (3, None, 0, 5, "x"), (4, "t", 0, None, "y")],
        [(5, "t", 0, 6, "a"), (6, "t", 0, 5, "b"), (7, None, 0, 5, "x"), (8, "t", 0, 2**62, "z")],
        [],
        [(9, "t", 0, 6, "c"), (10, "t", 0, 4, "d"), (11, "t", 0, None, "y"), (12, "t", 0, None, "w")],
    ]

    def run(rows):
        r = dedup.run_deliveries(store, spark.createDataFrame(rows, DELIVERIES), producer=("topic", "part"), seq="seq", arrival="id", exact_key=key)
        got.extend(x["first"] for x in r.arrivals.collect())

    def killed(*_):
        raise RuntimeError("killed")

    for rows in parts:
        monkeypatch.setattr(incremental.RunStore, "_rename_new", killed)
        with pytest.raises(Exception, match="killed"):
            run(rows)
        monkeypatch.setattr(incremental.RunStore, "_rename_new", rename)
        run(rows)
    assert sorted(got) == [1, 3, 4, 5, 8, 10, 12]
    assert sorted((x.lo, x.hi) for r in store.state("ranges").collect() for x in r.ranges) == [(4, 6), (2**62, 2**62)]


def test_a_changed_record_goes_out_as_it_was_kept(spark, tmp_path):
    """A record that changes while a run is under way is what the run gave out, or comes with the next one."""
    at, store = str(tmp_path / "t"), incremental.RunStore(spark, str(tmp_path / "s"))
    rows = lambda body: spark.createDataFrame([(1, body), (2, "same")], "id int, body string")
    rows("old").write.parquet(at)

    def process(fresh, changes):
        return fresh

    first = incremental.run_keyed(store, spark.read.parquet(at), ("id",), ("body",), process)
    assert store.output(commit=first).count() == 2
    rows("new").write.mode("overwrite").parquet(at)
    second = incremental.run_keyed(store, spark.read.parquet(at), ("id",), ("body",), process)
    assert [tuple(r) for r in store.output(commit=second).collect()] == [(1, "new")]
    gone = incremental.run_keyed(store, spark.read.parquet(at).where("id = 2"), ("id",), ("body",), lambda fresh, changes: changes.groupBy("change").count())
    assert [tuple(r) for r in store.output(commit=gone).collect()] == [("removed", 1)]


LIMITS = "job_id int, out_of_orderness_millis bigint, window_size_millis bigint, allowed_lateness_millis bigint"


def test_a_store_belongs_to_one_query(spark, tmp_path):
    batch = spark.createDataFrame([(1, "a", 5, 100)], "job_id int, name string, value bigint, timestamp bigint")
    stream = CorrectedStream(incremental.RunStore(spark, str(tmp_path)), spark.createDataFrame([(1, 0, 10, 0)], LIMITS))
    assert stream.take(batch, 7, "one") and stream.take(batch, 7, "one") is None
    with pytest.raises(ValueError, match="new store"):
        stream.take(batch, 0, "two")


def test_marks_of_a_live_stream(spark, tmp_path):
    rows = "job_id int, task int, timestamp bigint, row_id int"
    src = str(tmp_path / "in")
    for i, part in enumerate([[(1, 0, 100, 0), (None, 0, 5, 1)], [(1, 1, 50, 2), (1, 0, None, 3)], [(1, 0, 20, 4), (1, 1, 60, 5), (2, 0, 1, 6)]]):
        spark.createDataFrame(part, rows).coalesce(1).write.parquet(f"{src}/b={i}")
    store = incremental.RunStore(spark, str(tmp_path / "store"))
    limits = spark.createDataFrame([(1, 0, 10, 20)], LIMITS)
    stream = MarkedStream(store, limits, LateSpec(sources=("task",), expected=2), ("row_id",))
    read = spark.readStream.schema(rows).option("maxFilesPerTrigger", 1).parquet(f"{src}/*")
    for _ in range(2):  # the second start finds nothing new, and its store
        stream.start(read, str(tmp_path / "cp")).awaitTermination()
    got = {r.row_id: (r.watermark, r.arrival, r.below) for n in range(1, 4) for r in store.output(commit=store.commit(n)).collect()}
    assert got == {0: (None, "on_time", False), 1: (None, "untimed", False), 2: (None, "on_time", False), 3: (None, "untimed", False), 4: (49, "late", True), 5: (49, "on_time", False), 6: (None, "untimed", False)}
    with pytest.raises(Exception, match="new store"):
        stream.start(read, str(tmp_path / "other")).awaitTermination()
