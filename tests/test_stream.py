"""The facade: golden windows, aggregates, percentiles, connects."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fixture_model import GOLDEN, GOLDEN_LATE, ROWS, START
from tidemark import types as tt
from tidemark.functions import aggregates as A
from tidemark.functions import histogram as H
from tidemark.functions import scalars, windows
from tidemark.plans.stream import Stream
from tidemark.streaming.watermarks import IDLE, Aligner, RowWatermark, bounded

FOUR = [A.sum_("value"), A.max_("value"), A.min_("value"), A.count()]


def model(spark, rows=ROWS):
    return Stream(spark.createDataFrame(rows, tt.MODEL)).assign_timestamps(bounded(1000).with_timestamps("timestamp"))


def windows_of(df):
    return {(r.name, (r.window_start - START) // 1000): (r["sum(value)"], r["max(value)"], r["min(value)"], r["count"]) for r in df.collect()}


@pytest.mark.parametrize("share", [False, True])
def test_golden_windows(spark, share):
    out = model(spark).key_by("name").window(windows.hop(60_000, 20_000)).reduce(*FOUR, share_panes=share).df
    assert out.columns == ["name", "sum(value)", "max(value)", "min(value)", "count", "window_start", "window_end"]
    assert windows_of(out) == {(n, s): v for n in ("A-key-0", "B-key-0", "C-key-0") for s, v in GOLDEN.items()}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "partial_sum" in plan


def test_golden_windows_with_strict_lateness(spark):
    mark = RowWatermark(bounded(1000).wrap_time_periodic(10_000, 20_000), now=1)
    kept = [r for r in ROWS if mark.row(r[0], now=2)]
    assert [(n, v) for t, n, v in ROWS if (t, n, v) not in kept] == [(n, v) for v0 in ((4,), (7, 8)) for n in ("B-key-0", "C-key-0") for v in v0]
    out = model(spark, kept).key_by("name").window(windows.hop(60_000, 20_000)).reduce(*FOUR).df
    assert windows_of(out) == {(n, s): v for n, g in (("A-key-0", GOLDEN), ("B-key-0", GOLDEN_LATE), ("C-key-0", GOLDEN_LATE)) for s, v in g.items()}


def test_watermark_rules():
    w = RowWatermark(bounded(5))
    assert w.tick(0) == 0 and w.row(100, 0) and w.tick(1) == 94 and w.row(94, 1) and not w.row(93, 1)
    assert w.row(3, 1) is False and w.tick(2) == 94
    idle = RowWatermark(bounded(5).wrap_idleness(10))
    idle.row(100, 0)
    assert idle.tick(5) == 94 and idle.tick(11) == IDLE and idle.row(200, 12) and idle.tick(13) == 194
    a = Aligner(["1-0", "1-1", "2-0"])
    assert a.report("1-0", 10) is None and a.leave("2-0") is None and a.report("1-1", 9) == 9
    assert a.report("1-1", IDLE) == 10
    with pytest.raises(ValueError):
        bounded(-1)


@given(st.integers(0, 10**6), st.integers(1, 50), st.integers(1, 50), st.integers(-49, 49))
@settings(max_examples=300, deadline=None)
def test_window_starts(ts, size, slide, offset):
    if abs(offset) >= slide:
        with pytest.raises(ValueError):
            windows.hop(size, slide, offset)
        return
    w = windows.hop(size, slide, offset)
    last = ts - (ts - w.offset) % w.slide
    expected = [s for s in range(last - (-(-size // slide)) * slide, last + 1, slide) if s >= 0 and s <= ts < s + size]
    assert [s for k in range(-(-size // slide) - 1, -1, -1) for s in [last - k * slide] if s >= 0 and s + size > ts] == expected


@pytest.mark.parametrize(("size", "slide", "offset"), [(60, 20, 0), (60, 20, 7), (50, 20, -3), (20, 50, 10), (24, 24, -8), (30, 30, 0)])
def test_window_assignment_in_spark(spark, size, slide, offset):
    ts = [0, 1, 5, 19, 20, 59, 60, 61, 1000, 999_999]
    df = spark.createDataFrame([(t, "a", 1) for t in ts] + [(None, "a", 1)], tt.MODEL)
    got = {(r.timestamp, r.window_start, r.window_end) for r in Stream(df).assign_timestamps(bounded(0)).key_by("name").window(windows.hop(size, slide, offset)).assigned().collect()}
    assert got == {(t, s, s + size) for t in ts for s in range(-2 * slide + offset % slide, t + 1, slide) if s >= 0 and s <= t < s + size}


def test_utc8_day(spark):
    df = spark.createDataFrame([(START, "a", 1)], tt.MODEL)
    r = Stream(df).assign_timestamps(bounded(0)).key_by("name").window(windows.tumble(86_400_000, -8 * 3_600_000)).assigned().first()
    assert (r.window_start, r.window_end) == (1_583_856_000_000, 1_583_942_400_000)


def test_nulls_keys_and_empty_input(spark):
    rows = [(0, None, None), (0, None, 3), (0, "", None), (None, "x", 1)]
    out = {r.name: (r["sum(value)"], r["count"]) for r in model(spark, rows).key_by("name").window(windows.tumble(10)).reduce(*FOUR).df.collect()}
    assert out == {None: (3, 2), "": (None, 1)}
    assert model(spark, []).key_by("name").window(windows.hop(60, 20)).reduce(*FOUR).df.count() == 0
    with pytest.raises(ValueError):
        model(spark).key_by()
    with pytest.raises(ValueError):
        model(spark).key_by("nope")
    with pytest.raises(TypeError):
        model(spark).key_by("name").window(windows.tumble(10)).reduce(A.sum_("name"))
    with pytest.raises(ValueError):
        Stream(spark.createDataFrame(ROWS, tt.MODEL)).key_by(1).window(windows.tumble(10))


def test_same_type_sums(spark):
    df = spark.createDataFrame([(0, "a", 3), (0, "a", 4)], "timestamp bigint, name string, value int")
    s = Stream(df).assign_timestamps(bounded(0)).key_by("name").window(windows.tumble(10))
    assert s.reduce(A.sum_("value", same_type=True)).df.schema["sum(value)"].dataType.simpleString() == "int"
    assert s.reduce(A.sum_("value")).df.schema["sum(value)"].dataType.simpleString() == "bigint"


# -- percentiles


def read(counts, scale, p):
    total = sum(counts)
    pos = max(1, min(total, int(total * ((100 - p) / 100))))
    seen = 0
    for i in range(len(scale) - 1, -1, -1):
        seen += counts[i]
        if counts[i] and seen >= pos:
            return float(scale[i])
    return H.NOTHING


def count(values, scale):
    out = [0] * len(scale)
    for v in values:
        out[next((i for i, b in enumerate(scale) if b >= v), len(scale) - 1)] += 1
    return out


@pytest.mark.parametrize("scale", [H.SCALE_90, H.SCALE_345, (0.5, 2.0, 7.5)])
def test_percentiles(spark, scale):
    rnd = random.Random(1)
    rows = [(rnd.randint(0, 99), rnd.choice("ab"), rnd.choice([None, rnd.randint(-5, 2000), 10**9])) for _ in range(300)]
    for share in (False, True):
        out = model(spark, rows).key_by("name").window(windows.hop(60, 20)).reduce(A.pct("value", scale).named("h"), A.count().named("n"), A.pct("timestamp", scale).named("h2"), share_panes=share).df
        out = out.select("*", *(A.pct_value(F.col("h"), scale, p).alias(f"p{p}") for p in (0, 50, 90, 99, 100)), A.pct_value(F.col("h2"), scale, 50).alias("t50"))
        for r in out.collect():
            own = [x for x in rows if x[1] == r.name and r.window_start <= x[0] < r.window_end]
            counts = count([x[2] for x in own if x[2] is not None], scale)
            assert r.n == len(own)
            assert r.h == {i: c for i, c in enumerate(counts) if c}
            for p in (0, 50, 90, 99, 100):
                assert r[f"p{p}"] == read(counts, scale, p)
            assert r.t50 == read(count([x[0] for x in own], scale), scale, 50)


def test_percentile_of_three_values(spark):
    df = spark.createDataFrame([(0,), (1,), (2,)], "v int")
    h = df.select(H.bucket(F.col("v"), H.SCALE_345).alias("b")).groupBy("b").agg(F.count("*").alias("n")).agg(F.sort_array(F.collect_list(F.struct(F.col("b").alias("bucket"), "n"))).alias("pairs"))
    assert h.select(H.percentile(F.col("pairs"), F.lit(3).cast("bigint"), H.SCALE_345, 95)).first()[0] == 2
    assert len(H.SCALE_90) == 90 and len(H.SCALE_345) == 345 and len(H.SCALE_2400) == 2400
    assert h.select(H.percentile(F.array().cast("array<struct<bucket:int,n:bigint>>"), F.lit(0).cast("bigint"), (1, 2), 50)).first()[0] == H.NOTHING
    with pytest.raises(ValueError):
        H.percentile(F.col("x"), F.lit(1), (1, 2), 101)
    with pytest.raises(ValueError):
        H.check((2, 1))


def test_buckets_agree_and_states_round_trip(spark):
    df = spark.createDataFrame([(float(v),) for v in (-1, 0, 1, 1.5, 2, 100, 101, 1e9)] + [(None,)], "v double")
    r = df.select(H.bucket(F.col("v"), H.SCALE_90).alias("a"), H.bucket_small(F.col("v"), H.SCALE_90).alias("b")).collect()
    assert [x.a for x in r] == [x.b for x in r]
    assert H.decode(H.encode([1, 0, 70_000])) == [1, 0, 70_000]
    assert df.select(H.merge(F.array(F.lit(1), F.lit(300)), F.array(F.lit(2), F.lit(1)))).first()[0] == [3, 301]


# -- rows and several streams


def test_flat_map_filter_union(spark):
    s = Stream(spark.createDataFrame([(1, ["a", "b"]), (2, []), (3, None)], "id int, xs array<string>"))
    assert [tuple(r) for r in s.flat_map(F.col("xs"), "id").df.collect()] == [(1, "a"), (1, "b")]
    assert s.filter("id > 1").union(s).df.count() == 5
    assert s.flat_map_batches(lambda it: (f[f.id > 2][["id"]] for f in it), "id int").df.count() == 1
    assert s.replicate(3).df.count() == 9
    assert s.round_robin(3).df.rdd.getNumPartitions() == 3
    assert s.filter_windows(5, 9).df.count() == 3  # rows without a window pass


def test_connect(spark):
    a, b, c = (Stream(spark.createDataFrame([(x,)], "v string")) for x in "abc")
    out = a.connect(b, c).process(lambda df: df, lambda i, df: df.withColumn("seq", F.lit(i)) if i else None)
    assert sorted((r.v, r.seq) for r in out.df.collect()) == [("a", None), ("c", 1)]
    with pytest.raises(ValueError):
        a.connect(b).process(None)
    config = Stream(spark.createDataFrame([("a", 1)], "v string, w int"))
    for most in (10, 0):
        assert [tuple(r) for r in a.union(b).enrich(config, "v", most).df.orderBy("v").collect()] == [("a", 1), ("b", None)]


def test_custom_fold(spark):
    def step(acc, row):
        acc = acc or {"n": 0, "last": None}
        return {"n": acc["n"] + 1, "last": max(filter(None, (acc["last"], row["value"])), default=None)}

    def merge(a, b):
        return {"n": a["n"] + b["n"], "last": max((x for x in (a["last"], b["last"]) if x is not None), default=None)}

    rows = [(t, n, v) for t in range(40) for n, v in (("a", t), (None, None))]
    out = Stream(spark.createDataFrame(rows, tt.MODEL).repartition(5)).assign_timestamps(bounded(0)).key_by("name").window(windows.hop(20, 10)).fold(step, merge, "n bigint, last bigint").df
    got = {(r.name, r.window_start): (r.n, r["last"]) for r in out.collect()}
    assert got == {(n, s): (min(40, s + 20) - max(0, s), (min(40, s + 20) - 1) if n else None) for n in ("a", None) for s in range(0, 40, 10)}


def test_scalars(spark):
    r = spark.range(1).select(scalars.format_ms(F.lit(START)).alias("a"), scalars.timestamp_str(F.lit(START)).alias("b"), F.date_format(scalars.in_zone(F.lit(START)), scalars.DATE_TIME).alias("c"), scalars.decode_json(F.lit("{bad").cast("binary"), "x int").alias("d"), scalars.encode_json(F.lit(1).alias("x")).alias("e")).first()
    assert tuple(r) == ("2020-03-11 04:01:00", f"2020-03-11T04:01:00.000({START})", "2020-03-11 12:01:00", None, '{"x":1}') or r.d.x is None
    assert scalars.new_id("j") != scalars.new_id("j")


def test_types():
    assert tt.schema(("a", "u8"), ("b", "u64")).simpleString() == "struct<a:smallint,b:bigint>"
    assert tt.schema(("b", "u64"), times_as_long=False).simpleString() == "struct<b:decimal(20,0)>"
    assert tt.sub_schema(tt.MODEL, ["value", 0]).names == ["value", "timestamp"]
    with pytest.raises(ValueError):
        tt.schema(("a", "u128"))
    with pytest.raises(ValueError):
        tt.locate(tt.MODEL, 3)
