"""Heavy keys, rolling totals, deduplication, incremental runs."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import checkpoints, dedup, heavy, incremental, rolling

ROWS = "name string, timestamp bigint, value bigint"
DAY = 86_400_000


def test_per_key_counts_nulls_and_never_overflows(spark):
    big = 2**63 - 1
    d = [("a", 1, big)] * 5 + [("a", 1, None), (None, 1, 3), ("", 1, -4), ("n", 1, None)]
    df = spark.createDataFrame(d, ROWS).selectExpr("*", "1 as row_count", "2 as __key", "3 as S__HI")
    got = {r.name: tuple(r)[1:] for r in heavy.per_key(df).collect()}
    assert got == {"a": (6, 5, 5 * big, big, big), None: (1, 1, 3, 3, 3), "": (1, 1, -4, -4, -4), "n": (1, 0, None, None, None)}
    assert [r.name for r in heavy.heavy_keys(df, share=(1, 2)).collect()] == ["a"]
    assert heavy.per_key(df.limit(0)).count() == 0
    assert heavy.heavy_keys(df.limit(0)).count() == 0


def test_per_key_is_combined_before_the_shuffle(spark):
    plan = heavy.per_key(spark.createDataFrame([("a", 1, 1)], ROWS))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("HashAggregate") == 2 and "partial_sum" in plan and "Python" not in plan


@pytest.mark.parametrize("seed", range(2))
def test_rolling_totals(spark, seed):
    rnd = random.Random(seed)
    d = [(rnd.choice(["a", "b", "", None]), rnd.choice([None, rnd.randint(-3, 90) * DAY + rnd.randint(0, DAY - 1)]), rnd.choice([None, rnd.randint(-100, 100), 10**15])) for _ in range(60)]
    got = {(r.name, r.day): r for r in rolling.rolling_totals(spark.createDataFrame(d, ROWS).selectExpr("*", "1 as day", "2 as d")).collect()}
    keys = set()
    for name in {x[0] for x in d}:
        own = [(x[1] // DAY, x[2]) for x in d if x[0] == name and x[1] is not None]
        for day in range(min(x[0] for x in own), max(x[0] for x in own) + 1) if own else ():
            k = (name, date(1970, 1, 1) + timedelta(days=day))
            keys.add(k)
            assert got[k].rows_today == sum(x[0] == day for x in own)
            for w in (7, 30):
                v = [x[1] for x in own if day - w < x[0] <= day and x[1] is not None]
                assert got[k][f"total_{w}d"] == sum(v) and got[k][f"n_{w}d"] == len(v)
                assert got[k][f"avg_{w}d"] == (pytest.approx(sum(v) / len(v)) if v else None)
    assert set(got) == keys


def test_rolling_totals_of_nothing(spark):
    assert rolling.rolling_totals(spark.createDataFrame([], ROWS)).count() == 0
    assert rolling.rolling_totals(spark.createDataFrame([("a", None, 1), ("b", 2**62, 1)], ROWS)).count() == 0


DELIVERIES = "id bigint, topic string, part int, seq bigint, body string"


def run(spark, parts):
    seen, accepted, rejected = dedup.Seen(), [], {}
    for p in parts:
        r = dedup.accept_once(spark.createDataFrame(p, DELIVERIES), seen, producer=("topic", "part"), seq="seq", arrival="id", exact_key=F.concat_ws("|", F.coalesce("topic", F.lit("?")), F.coalesce(F.col("part").cast("string"), F.lit("?")), F.coalesce(F.col("seq").cast("string"), F.lit("?")), "body"))
        accepted += [x["first"] for x in r.arrivals.collect()]
        seen = r.seen(seen)
    return accepted, seen


@pytest.mark.parametrize("seed", range(2))
def test_each_message_is_accepted_once(spark, seed):
    rnd = random.Random(seed)
    d = [(i, rnd.choice(["t", "u", None]), rnd.choice([0, 1, None]), rnd.choice([None, rnd.randint(-5, 40), rnd.randint(16380, 16390), 2**62]), rnd.choice(["x", "y"])) for i in range(400)]
    parts = [d[:150], [], d[150:300], d[250:]]
    accepted, seen = run(spark, parts)
    first = {}
    for x in d:
        key = x[1:4] if None not in x[1:4] else x[1:]
        first.setdefault(key, x[0])
    assert sorted(accepted) == sorted(first.values())
    numbers = set()
    for r in seen.ranges.collect():
        edges = [(x.lo, x.hi) for x in r.ranges]
        assert all(a[1] + 1 < b[0] for a, b in zip(edges, edges[1:]))  # disjoint, and never adjacent
        assert all(lo >> dedup.BLOCK_BITS == hi >> dedup.BLOCK_BITS == r.block for lo, hi in edges)
        numbers |= {(r.topic, r.part, n) for lo, hi in edges for n in range(lo, hi + 1)}
    assert numbers == {x[1:4] for x in d if None not in x[1:4]}


def test_runs_of_meet_every_row_once(spark):
    df = spark.createDataFrame([(i, b) for i, b in enumerate([0, 1, 5, 9, 9, None])], "id int, b bigint")
    for n in (1, 2, 3, 20):
        ids = [r.id for c in dedup.runs_of(df, "b", n) for r in df.where(c).collect()]
        assert sorted(ids) == list(range(6))
    assert len(dedup.runs_of(df.limit(0), "b", 3)) == 1


def numbers(df):
    return sorted((r.space, r.n) for r in df.collect())


@pytest.mark.parametrize("seed", range(2))
def test_new_numbers(spark, seed):
    rnd = random.Random(seed)
    draw = lambda n: [(rnd.choice(["p", "q", None]), rnd.choice([rnd.randint(0, 300), rnd.randint(10**6, 10**6 + 9000), 2**62, -1, -70, None])) for _ in range(n)]
    old, new = draw(200), draw(200)
    w = lambda rows: incremental.words(spark.createDataFrame(rows, "space string, n bigint"), ("space",), "n")
    got = numbers_(incremental.new_numbers(w(old + new + new), w(old), ("space",), "n"))
    assert got == sorted({x for x in new if x[1] is not None} - set(old), key=str)
    assert incremental.new_numbers(w(old), w(old), ("space",), "n").count() == 0
    assert incremental.new_numbers(w([]), w([]), ("space",), "n").count() == 0


def numbers_(df):
    return sorted(((r.space, r.n) for r in df.collect()), key=str)


def test_upto_cuts_words(spark):
    w = incremental.words(spark.createDataFrame([("p", i) for i in range(200)] + [("q", 3), ("r", 3)], "space string, n bigint"), ("space",), "n")
    for at in (0, 62, 63, 64, 127, 150, 199, 500):
        offs = spark.createDataFrame([("p", at), ("q", None)], "space string, saved bigint")
        done = incremental.upto(w, offs, ("space",), "saved")
        got = incremental.new_numbers(w, done, ("space",), "n").collect()
        assert sorted((r.space, r.n) for r in got) == [("p", i) for i in range(at + 1, 200)] + [("q", 3), ("r", 3)]


def test_runs_publish_output_and_state_together(spark, tmp_path):
    store = incremental.RunStore(spark, str(tmp_path / "store"))
    table = lambda n: spark.createDataFrame([("p", i) for i in range(n)] * 2, "space string, n bigint")
    outputs = []

    def process(fresh):
        return fresh

    for n in (10, 10, 25):
        commit = incremental.run_numbered(store, table(n), ("space",), "n", process)
        outputs.append([r.n for r in spark.read.parquet(commit["outputs"]["output"]).orderBy("n").collect()])
    assert outputs == [list(range(10)), [], list(range(10, 25))]

    def fails(fresh):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        incremental.run_numbered(store, table(40), ("space",), "n", fails)
    # a run that wrote its output but not its commit leaves nothing behind
    table(40).write.parquet(str(tmp_path / "store/runs/4-dead/output"))
    commit = incremental.run_numbered(store, table(40), ("space",), "n", process)
    assert commit["run"] == 4
    assert [r.n for r in spark.read.parquet(commit["outputs"]["output"]).orderBy("n").collect()] == list(range(25, 40))


def test_two_writers_of_one_run(spark, tmp_path, monkeypatch):
    a, b = (incremental.RunStore(spark, str(tmp_path)) for _ in range(2))
    df = spark.range(1)
    a.publish(df, df)
    monkeypatch.setattr(b, "last", lambda: None)
    with pytest.raises(RuntimeError):
        b.publish(df, df)


def test_keyed_changes(spark, tmp_path):
    schema = "id bigint, body string, watermark int"
    one = [(i, f"b{i}", 0) for i in range(50)] + [(None, "n", 0), (7, "b7", 0)]
    two = [(i, f"b{i}" if i != 3 else "other", 1) for i in range(10, 60)] + [(3, "changed", 1), (7, "b7", 0), (None, None, 0)]
    index = lambda d: incremental.key_index(spark.createDataFrame(d, schema), ("id",), ("body",))
    got = {r.change: r.n for r in incremental.record_changes(index(two), index(one)).groupBy("change").agg(F.count("*").alias("n")).collect()}
    keys = lambda d: {k: sorted(str(x[1]) for x in d if x[0] == k) for k in {x[0] for x in d}}
    a, b = keys(one), keys(two)
    assert got == {"added": len(b.keys() - a.keys()), "removed": len(a.keys() - b.keys()), "changed": sum(a[k] != b[k] for k in a.keys() & b.keys())}
    assert incremental.record_changes(index(one), index(list(reversed(one)))).count() == 0
    store = incremental.RunStore(spark, str(tmp_path))
    seen = []
    for d in (one, two):
        commit = incremental.run_keyed(store, spark.createDataFrame(d, schema), ("id",), ("body",), lambda fresh, changes: fresh)
        seen.append({r.id for r in spark.read.parquet(commit["outputs"]["output"]).collect()})
    assert seen[1] == {k for k in b if a.get(k) != b[k]}


CK = "id bigint, application_name string, application_id string, job_id int, task_number int, num_tasks int, operator_id int, checkpoint_id bigint, completed_checkpoint_id bigint, handle string"


def test_saved_offsets(spark):
    h = lambda o: f'{{"topic": "t", "partition": 0, "offset": {o}}}'
    d = [
        (1, "a", "1", 0, 0, 1, 0, 10, 0, h(5)), (2, "a", "1", 1, 0, 2, 4, 10, 0, None), (3, "a", "1", 1, 1, 2, 4, 10, 0, ""),
        (4, "a", "1", 0, 0, 1, 0, 20, 0, "{broken"), (5, "a", "1", 0, 0, 1, 0, 20, 0, h(9)), (6, "a", "1", 1, 0, 2, 4, 20, 10, "{}"), (7, "a", "1", 1, 1, 2, 4, 20, 0, None),
        (8, "a", "1", 0, 0, 1, 0, 30, 0, h(12)), (9, "a", "1", 1, 0, 2, 4, 30, 0, None),  # one task did not report
        (10, "b", "1", 0, 0, 2, 0, 10, 0, '{"topic":"u","partition":1,"offset":3}'),  # never complete
    ]
    got = checkpoints.saved_offsets(spark.createDataFrame(d, CK))
    assert [tuple(r) for r in got.collect()] == [("t", 0, 5)]
    assert checkpoints.saved_offsets(spark.createDataFrame([], CK)).count() == 0
