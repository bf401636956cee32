"""Sketches: codes, accuracy, merging, deletions, and the exact form of small groups."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import quantiles as q

PROBS = (0.01, 0.25, 0.5, 0.9, 0.99)


@given(st.lists(st.floats(allow_nan=False, allow_infinity=True), min_size=1, max_size=50))
@settings(max_examples=100, deadline=None)
def test_codes_keep_order_and_nearly_the_value(values):
    sk, v = q.Sketch(), np.sort(np.array(values, dtype=float))
    codes = sk.encode(v)
    assert (np.diff(codes) >= 0).all()
    finite = np.isfinite(v) & (np.abs(v) > 1e-300)
    assert (np.abs(sk.decode(codes)[finite] - v[finite]) <= np.abs(v[finite]) * 2.0**-20).all()


def test_whole_numbers_are_exact():
    v = np.array([0, 1, -1, 2**21 - 1, -(2**21) + 1, 12345, -54321], dtype=float)
    assert (q.Sketch().decode(q.Sketch().encode(v)) == v).all()


@pytest.mark.parametrize("kind", ["uniform", "lognormal", "normal", "zipf", "two", "binary orders"])
def test_rank_error_is_within_the_bound(kind):
    rng = np.random.default_rng(5)
    v = {
        "uniform": lambda: rng.random(60_000), "lognormal": lambda: rng.lognormal(5, 2, 60_000), "normal": lambda: rng.normal(0, 1e3, 60_000), "zipf": lambda: rng.zipf(1.3, 60_000).astype(float),
        "two": lambda: rng.choice([-5.0, 7.0], 60_000), "binary orders": lambda: 2.0 ** rng.uniform(-9, 9, 60_000),
    }[kind]()
    sk = q.Sketch()
    codes = np.sort(sk.encode(v))
    own, w = np.unique(codes, return_counts=True)
    counters = np.zeros(sk.cells, dtype=np.int64)
    sk.add(counters, own, w)
    targets = np.ceil(np.array(PROBS) * len(v))
    got = sk.invert(counters, targets)
    lo, hi = np.searchsorted(codes, got, "left"), np.searchsorted(codes, got, "right")
    assert (np.maximum(lo + 1 - targets, targets - hi) <= sk.rank_error * len(v)).all()
    # linear: halves add up, and what is taken back is gone
    a, b = np.zeros_like(counters), np.zeros_like(counters)
    sk.add(a, own[::2], w[::2])
    sk.add(b, own[1::2], w[1::2])
    assert (a + b == counters).all()
    sk.add(counters, own, -w)
    assert not counters.any()


def exact(values, p):
    return sorted(values)[max(1, math.ceil(p * len(values))) - 1]


def test_groups_with_nulls_ties_and_clashing_names(spark):
    rnd = random.Random(1)
    d = [(rnd.choice(["a", "b", "", None]), rnd.choice([None, 5, 5, rnd.randint(-1000, 1000)]), 1) for _ in range(500)] + [("only null", None, 1), ("one", 7, 1)]
    df = spark.createDataFrame(d, "name string, value bigint, n int").selectExpr("*", "true as dense", "1 as cells", "2 as __value")
    got = {r.name: r for r in q.percentiles(df, ["name"], "value", PROBS).collect()}
    assert set(got) == {"a", "b", "", None, "one"}
    for name, r in got.items():
        own = [x[1] for x in d if x[0] == name and x[1] is not None]
        assert r.n == len(own) and r.exact
        for p in PROBS:
            assert r[q.column_of(p)] == exact(own, p)
    assert q.percentiles(df.limit(0), ["name"], "value").count() == 0


def test_nan_is_skipped_and_infinity_kept(spark):
    df = spark.createDataFrame([("a", float("nan")), ("a", float("inf")), ("a", 1.0), ("a", None)], "k string, v double")
    r = q.percentiles(df, ["k"], "v", (0.5, 1.0)).first()
    assert (r.n, r.p50, r.p100) == (2, 1.0, float("inf"))


@pytest.mark.parametrize("limit", [8, 100_000])
def test_days_merge_to_the_whole_and_deletions_undo(spark, limit):
    sk = q.Sketch(sparse_limit=limit)
    rnd = random.Random(2)
    d = [(rnd.choice("ab"), rnd.randint(0, 5000), i % 3, 1) for i in range(3000)]
    gone = [("a", 999_999, 1, 1), ("a", 999_999, 2, -1)] * 200 + [("c", 4, 0, 1), ("c", 4, 1, -1)]
    df = spark.createDataFrame(d + gone, "k string, v bigint, day int, w int").repartition(5)
    days = q.merge(q.summarise(df, ["k", "day"], "v", "w", sk), ["k", "day"], sk)
    got = {r.k: r for r in q.merge(days.drop("day"), ["k"], sk, rounds=2, probs=PROBS, fan_in=3).collect()}
    whole = {r.k: r for r in q.percentiles(df, ["k"], "v", PROBS, "w", sk).collect()}
    assert got == whole  # the same whatever was merged first
    assert got["c"].n == 0 and got["c"].p50 is None
    for k in "ab":
        own = sorted(x[1] for x in d if x[0] == k)
        assert got[k].n == len(own) and got[k].exact == (limit > 8)
        for p in PROBS:
            v, t = got[k][q.column_of(p)], math.ceil(p * len(own))
            below, upto = sum(x < v for x in own), sum(x <= v for x in own)
            assert max(below + 1 - t, t - upto, 0) <= (0 if limit > 8 else sk.rank_error * len(own))


def test_a_task_folds_in_bounded_pieces(spark, monkeypatch):
    monkeypatch.setattr(q, "FLUSH", 50)
    d = [(f"k{i % 7}", i) for i in range(1000)]
    got = {r.k: (r.n, r.p50) for r in q.percentiles(spark.createDataFrame(d, "k string, v bigint").coalesce(1), ["k"], "v").collect()}
    assert got == {f"k{j}": (len(x), exact(x, 0.5)) for j in range(7) for x in [[i for i in range(1000) if i % 7 == j]]}


def test_a_large_group_leaves_a_task_as_one_state(spark, monkeypatch):
    monkeypatch.setattr(q, "FLUSH", 200)
    d = [("hot", i % 150) for i in range(2000)] + [(f"k{i}", i) for i in range(2000)]
    random.Random(4).shuffle(d)
    df = spark.createDataFrame(d, "k string, v bigint").coalesce(1)
    states = q.summarise(df, ["k"], "v")
    assert states.where("k = 'hot'").count() == 1
    got = {r.k: (r.n, r.p50) for r in q.merge(states, ["k"], probs=(0.5,)).collect()}
    assert got["hot"] == (2000, exact([x for k, x in d if k == "hot"], 0.5)) and len(got) == 2001


def test_every_group_is_sketched_if_asked(spark):
    df = spark.createDataFrame([("a", i) for i in range(500)] + [("b", 3)], "k string, v bigint")
    got = {r.k: r for r in q.percentiles(df, ["k"], "v", (0.5,), sk=q.Sketch(sparse_limit=0)).collect()}
    assert not got["a"].exact and not got["b"].exact and got["b"].p50 == 3
    assert abs(got["a"].p50 - 249) <= q.Sketch().rank_error * 500 + 1
