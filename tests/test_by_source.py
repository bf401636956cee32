"""Several sources in a group: a low watermark that never falls, on a stream and over history, against a row model."""

import random

import pytest

from tidemark.operators import late
from tidemark.operators.incremental import RunStore
from tidemark.plans import general
from tidemark.streaming.corrections import CorrectedStream

SCHEMA = "row_id bigint, timestamp bigint, name string, value bigint, job_id int, task_number int, batch_id bigint"
LIMITS = "job_id int, out_of_orderness_millis bigint, window_size_millis bigint, allowed_lateness_millis bigint"
LIM = {1: (5, 10, 20), 2: (0, 7, 3)}


def model(data, idle):
    """{row_id: arrival}, the low mark before each batch being carried forward as a maximum over batches."""
    out, low = {}, {}
    for b in range(max(r[6] for r in data) + 1):
        for job in LIM:
            per = {}
            for _, t, _, _, j, task, at in data:
                if j == job and at < b and t is not None:
                    m, s = per.get(task, (t, at))
                    per[task] = (max(m, t), max(s, at))
            active = [m for m, s in per.values() if idle is None or b - s <= idle]
            if active:
                low[job] = max(low.get(job, min(active)), min(active))
        for rid, t, _, _, job, _, at in data:
            if at != b:
                continue
            if t is None or job not in LIM:
                out[rid] = late.UNTIMED
                continue
            delay, size, allowed = LIM[job]
            end = (t // size + 1) * size
            w = low[job] - delay - 1 if job in low else None
            out[rid] = late.ON_TIME if w is None or end > w else late.LATE if end + allowed > w else late.DIVERTED
    return out


def uneven(seed, batches=6):
    """Task 1 trails the others, task 2 appears late, and job 2 falls silent in batches 2 to 4."""
    rnd = random.Random(seed)
    rows = []
    for b in range(batches):
        for _ in range(30):
            job, task = rnd.choice([1, 1, 2, 9, None]), rnd.choice([0, 0, 1] if b < 3 else [0, 2, 2, None])
            if job == 2 and 1 < b < 5:
                continue
            t = None if rnd.random() < 0.1 else b * 20 + rnd.randint(-60, 10) - (40 if task in (1, 2) else 0)
            rows.append((len(rows), t, rnd.choice("ab"), rnd.choice([None, 1, 7]), job, task, b))
    return rows


@pytest.mark.parametrize("idle", [None, 1])
def test_corrected_stream_keeps_marks_by_source(spark, tmp_path, idle):
    data, final, out = uneven(1), {}, {"diverted": [], "untimed": []}
    want = model(data, idle)
    spec = late.LateSpec(sources=("task_number",), idle_batches=idle)
    stream = CorrectedStream(RunStore(spark, str(tmp_path / "store")), spark.createDataFrame([(k, *v) for k, v in LIM.items()], LIMITS), value="row_id", spec=spec)
    for b in range(6):
        commit = stream.take(spark.createDataFrame([r for r in data if r[6] == b], SCHEMA), b)
        for r in spark.read.parquet(commit["outputs"]["output"]).collect():
            final[r.job_id, r.name, r.window_start] = (r.sum_value, r.row_count)
        for k, ids in out.items():
            ids += [r.row_id for r in spark.read.parquet(commit["outputs"][k]).collect()]
    for r in stream.flush(9).collect():
        final[r.job_id, r.name, r.window_start] = (r.sum_value, r.row_count)
    expected = {}
    for rid, t, name, _, job, _, _ in data:
        if want[rid] in (late.ON_TIME, late.LATE):
            size = LIM[job][1]
            total, n = expected.get((job, name, t - t % size), (0, 0))
            expected[job, name, t - t % size] = (total + rid, n + 1)
    assert {k: sorted(ids) for k, ids in out.items()} == {k: sorted(i for i, a in want.items() if a == k) for k in out}
    assert all(out.values())
    assert final == expected


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("idle", [None, 1])
def test_low_watermarks_never_fall(spark, seed, idle):
    data = uneven(seed)
    spec = late.LateSpec(sources=("task_number",), idle_batches=idle, monotone=True)
    got = {r.row_id: r.arrival for r in late.classify(spark.createDataFrame(data, SCHEMA), spark.createDataFrame([(k, *v) for k, v in LIM.items()], LIMITS), spec).collect()}
    assert got == model(data, idle)


def test_an_idle_or_returning_source_reopens_nothing(spark):
    rows = [(0, 100, 0, 0), (1, 200, 1, 0), (2, 100, 0, 3), (3, 100, 0, 5), (4, 10, 0, 9), (5, 10, 2, 4)]  # row, time, task, batch
    data = [(i, t, "a", 1, 2, task, b) for i, t, task, b in rows]
    spec = late.LateSpec(sources=("task_number",), idle_batches=1, monotone=True)
    got = {r.row_id: r.arrival for r in late.classify(spark.createDataFrame(data, SCHEMA), spark.createDataFrame([(2, 0, 7, 3)], LIMITS), spec).collect()}
    assert got == {0: late.ON_TIME, 1: late.ON_TIME, 2: late.ON_TIME, 3: late.ON_TIME, 4: late.DIVERTED, 5: late.DIVERTED}


def test_the_registered_query_keeps_its_low_mark():
    assert general.BY_TASK.monotone
