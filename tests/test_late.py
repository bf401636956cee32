"""Late events against a row-at-a-time model."""

import random

import pytest

from tidemark.operators import late

SCHEMA = "row_id bigint, timestamp bigint, name string, value bigint, job_id int, task_number int, batch_id bigint"
LIMITS = "job_id int, out_of_orderness_millis bigint, window_size_millis bigint, allowed_lateness_millis bigint"
SPEC = late.LateSpec()


def limits(spark):
    return spark.createDataFrame([(1, 5, 10, 20), (2, 0, 7, 0)], LIMITS)


def model(data, lim, sources=False, idle=None):
    out = {}
    for rid, t, _, _, job, task, b in data:
        if t is None or job not in lim:
            out[rid] = late.UNTIMED
            continue
        delay, size, allowed = lim[job]
        before = [r for r in data if r[4] == job and r[6] < b and r[1] is not None]
        if sources:
            per = {}
            for r in before:
                m, s = per.get(r[5], (r[1], r[6]))
                per[r[5]] = (max(m, r[1]), max(s, r[6]))
            marks = [m for m, s in per.values() if idle is None or b - s <= idle]
            mark = min(marks) if marks else None
        else:
            mark = max((r[1] for r in before), default=None)
        end = (t // size + 1) * size
        w = None if mark is None else mark - delay - 1
        out[rid] = late.ON_TIME if w is None or end > w else late.LATE if end + allowed > w else late.DIVERTED
    return out


def data(seed, n=300):
    rnd = random.Random(seed)
    return [(i, None if rnd.random() < 0.05 else i // 3 + rnd.randint(-60, 10), rnd.choice(["a", "b", "", None]), rnd.choice([None, -5, 3, 10**15]), rnd.choice([1, 1, 1, 2, 9]), rnd.randint(0, 2), i // 20) for i in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_arrivals_match_the_model(spark, seed):
    d = data(seed)
    got = {r.row_id: r.arrival for r in late.classify(spark.createDataFrame(d, SCHEMA), limits(spark)).collect()}
    assert got == model(d, {1: (5, 10, 20), 2: (0, 7, 0)})


@pytest.mark.parametrize("idle", [None, 2])
def test_arrivals_by_source(spark, idle):
    d = data(7)
    spec = late.LateSpec(sources=("task_number",), idle_batches=idle)
    got = {r.row_id: r.arrival for r in late.classify(spark.createDataFrame(d, SCHEMA), limits(spark), spec).collect()}
    assert got == model(d, {1: (5, 10, 20), 2: (0, 7, 0)}, True, idle)


def test_without_broadcasts_the_result_is_the_same(spark):
    d = data(1)
    spec = late.LateSpec(max_broadcast_rows=0)
    got = {r.row_id: r.arrival for r in late.classify(spark.createDataFrame(d, SCHEMA), limits(spark), spec).collect()}
    assert got == model(d, {1: (5, 10, 20), 2: (0, 7, 0)})


def test_windows_and_revisions(spark):
    d = data(3)
    c = late.classify(spark.createDataFrame(d, SCHEMA), limits(spark), SPEC, ("row_id", "name", "value"))
    kept = [r for r in c.collect() if r.arrival in (late.ON_TIME, late.LATE)]
    got = {(r.job_id, r.name, r.window_start): r for r in late.corrected_windows(c).collect()}
    for k, r in got.items():
        own = [x for x in kept if (x.job_id, x.name, x.window_start) == k]
        first = [x for x in own if x.arrival == late.ON_TIME]
        for tag, some in (("first", first), ("final", own)):
            v = [x.value for x in some if x.value is not None]
            assert r[f"{tag}_row_count"] == len(some)
            assert r[f"{tag}_sum_value"] == (sum(v) if v else None)
            assert r[f"{tag}_max_value"] == max(v, default=None) and r[f"{tag}_min_value"] == min(v, default=None)
    assert set(got) == {(x.job_id, x.name, x.window_start) for x in kept}
    last = {}
    for r in late.revisions(c).orderBy("revision").collect():
        last[r.job_id, r.name, r.window_start] = r
    assert {k: (r.sum_value, r.row_count) for k, r in last.items()} == {k: (r.final_sum_value, r.final_row_count) for k, r in got.items()}


def test_empty_and_clashing_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert late.classify(empty, limits(spark)).count() == 0
    assert late.classify(empty, limits(spark), late.LateSpec(sources=("task_number",))).count() == 0
    extra = spark.createDataFrame(data(0, 20), SCHEMA).selectExpr("*", "1 as watermark", "2 as window_end", "3 as mark", "4 as MARK", "5 as __size")
    assert late.classify(extra, limits(spark)).count() == 20
    with pytest.raises(ValueError):
        late.classify(extra, limits(spark), keep=("row_id", "watermark"))
