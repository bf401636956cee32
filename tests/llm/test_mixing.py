"""Water-filling and seeded choice."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import mixing

DOCS = "doc_id bigint, source string, text string"
TARGETS = "source string, target_share double, max_repeats int"


@given(st.lists(st.tuples(st.floats(0.001, 1), st.integers(0, 5), st.integers(0, 1000)), min_size=1, max_size=8))
@settings(max_examples=200, deadline=None)
def test_water_filling_is_feasible_and_fair(sources):
    targets = [(str(i), w, r) for i, (w, r, _) in enumerate(sources)]
    have = {str(i): n for i, (_, _, n) in enumerate(sources)}
    shares = mixing.water_fill(targets, have)
    total = sum(have.values())
    open_ = [s for s in shares if s.amount < s.max_repeats * s.available - 1e-6]
    for s in shares:
        assert s.amount <= s.max_repeats * s.available + 1e-6
    # those below their cap share one level; the clamped ones would get no less at that level
    if open_:
        level = open_[0].amount / open_[0].target
        assert all(s.amount / s.target == pytest.approx(level, rel=1e-6, abs=1e-9) for s in open_)
        assert all(s.amount <= level * s.target * (1 + 1e-9) + 1e-6 for s in shares)
        assert sum(s.amount for s in shares) == pytest.approx(total, rel=1e-6, abs=1e-6)


def test_clamping_goes_on_until_feasible():
    shares = {s.source: s for s in mixing.water_fill([("a", 0.5, 1), ("b", 0.4, 1), ("c", 0.1, 99)], {"a": 10, "b": 39, "c": 51})}
    assert {k: round(s.amount, 6) for k, s in shares.items()} == {"a": 10, "b": 39, "c": 51}
    assert {k: s.short for k, s in shares.items()} == {"a": True, "b": True, "c": False}


@pytest.fixture
def corpus(spark):
    rnd = random.Random(3)
    docs = [(i, rnd.choice(["web", "WEB ", "\tbook ", "code", "other", None]), rnd.choice([None, "", "a, b!", "word " * rnd.randint(1, 60)])) for i in range(800)]
    return docs, spark.createDataFrame(docs, DOCS).selectExpr("*", "1 as size", "2 as u", "3 as doc", "4 as whole")


def test_shares_caps_and_repeats(spark, corpus):
    docs, df = corpus
    targets = spark.createDataFrame([("web", 0.3, 2), ("Book", 0.6, 4), ("code", 0.1, 1), ("none", 0.0001, 3)], TARGETS)
    m = mixing.Mixer(df, targets, seed=11)
    plan = {r.source: r for r in m.plan().collect()}
    chosen = m.chosen().collect()
    by_doc = {}
    for r in chosen:
        by_doc.setdefault((r.doc, r.source), []).append(r.copy)
    key = lambda s: None if s is None else s.strip().lower()
    source = {i: key(s) for i, s, _ in docs}
    for (doc, s), copies in by_doc.items():
        assert source[doc] == s and sorted(copies) == list(range(1, len(copies) + 1)) and len(copies) <= {"web": 2, "book": 4, "code": 1}[s]
    reached = {r.source: r for r in m.reached().collect()}
    most = max(r["size"] for r in chosen)
    for name, p in plan.items():
        assert abs(reached[name]["size"] - p.amount) <= most  # within one document
    assert reached["none"]["size"] == 0 and plan["none"].short
    assert sum(r.share for r in reached.values()) == pytest.approx(1)
    again = mixing.Mixer(df.repartition(7), targets, seed=11).chosen().collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, chosen))
    assert sorted(map(tuple, mixing.Mixer(df, targets, seed=12).chosen().collect())) != sorted(map(tuple, chosen))


def test_sizes(spark, corpus):
    m = mixing.Mixer(spark.createDataFrame([(1, "a", "Two words, one mark\n!"), (2, "a", None), (3, "a", "  ")], DOCS), spark.createDataFrame([("a", 1.0, 1)], TARGETS))
    assert {r.doc: r["size"] for r in m.sized.collect()} == {1: 6, 2: 0, 3: 0}


def test_empty_tables_and_refused_targets(spark, corpus):
    _, df = corpus
    targets = spark.createDataFrame([("web", 1.0, 1)], TARGETS)
    m = mixing.Mixer(df.limit(0), targets)
    assert m.chosen().count() == 0 and [tuple(r) for r in m.reached().collect()] == [("web", 1.0, 0, 0, 0.0)]
    assert mixing.Mixer(df, targets.limit(0)).chosen().count() == 0
    with pytest.raises(ValueError):
        mixing.Mixer(df, spark.createDataFrame([("web", 0.5, 1), (" WEB", 0.5, 1)], TARGETS))


def test_tokenizer_sizes(spark):
    tokenizers = pytest.importorskip("public_tokenizers")
    df = spark.createDataFrame([(1, "a", "hello <|endoftext|> world"), (2, "a", None), (3, "a", "")], DOCS)
    for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"):
        m = mixing.Mixer(df, spark.createDataFrame([("a", 1.0, 1)], TARGETS), size=mixing.tokenizer_size(str(tokenizers.path(name))))
        got = {r.doc: r["size"] for r in m.sized.collect()}
        assert got[1] > 4 and got[2] == got[3] == 0


def test_token_shares_match_the_tokenizer(spark, corpus):
    tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    docs, df = corpus
    path = str(tokenizers.path("byte_bpe_50k.json"))
    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    targets = spark.createDataFrame([("web", 0.5, 2), ("book", 0.5, 1)], TARGETS)
    plan = {r.source: r for r in mixing.Mixer(df, targets, size=mixing.tokenizer_size(path)).plan().collect()}
    for name in ("web", "book"):
        assert plan[name].available == sum(len(tok.encode(t, add_special_tokens=False).ids) for _, s, t in docs if s and t and s.strip().lower() == name)
