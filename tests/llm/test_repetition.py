"""Repeated runs against a word-by-word count; the label model on votes with known accuracies."""

import random

import numpy as np
import pytest

from tidemark.llm import repetition as rep

DOCS = "doc_id bigint, text string"


def brute(words, run=8):
    seen, covered = set(), set()
    for i in range(len(words) - run + 1):
        r = tuple(words[i : i + run])
        if r in seen:
            covered |= set(range(i, i + run))
        seen.add(r)
    return len(covered)


def texts(seed):
    rnd = random.Random(seed)
    out = []
    for i in range(60):
        base = [rnd.choice("abcdefghij") + str(rnd.randint(0, rnd.choice([1, 30]))) for _ in range(rnd.randint(0, 60))]
        words = base + (base[: rnd.randint(0, 20)] * rnd.randint(0, 3))
        out.append((i, " ".join(words)))
    return [*out, (100, None), (101, ""), (102, "... \n\n"), (103, "x " * 500), (0, "a b " * 9)]


@pytest.mark.parametrize("chunk", [1 << 20, 30])
def test_repeated_words(spark, monkeypatch, chunk):
    monkeypatch.setattr(rep, "CHUNK", chunk)
    d = texts(4)
    df = spark.createDataFrame(d, DOCS).selectExpr("*", "1 as words", "2 as doc", "3 as n_words")
    got = sorted((r.doc, r.n_words, r.repeated_words, r.distinct_words) for r in rep.measure(df).collect())
    assert got == sorted((i, len((t or "").replace(".", "").split()), brute((t or "").replace(".", "").split()), len(set((t or "").replace(".", "").split()))) for i, t in d)


def test_pieces_and_phrases(spark):
    t = "Same line here.\nother\nSAME line here.\n\nother\n\nlast one"
    r = rep.measure(spark.createDataFrame([(1, t), (2, "one two three one two three one")], DOCS)).collect()
    r = {x.doc: x for x in r}
    assert r[1].n_lines == 5 and r[1].line_share == pytest.approx(20 / (15 + 5 + 15 + 5 + 8))
    assert r[1].n_paragraphs == 3 and r[1].paragraph_share == 0
    assert r[2].top_phrase == 2


def test_em_finds_the_accuracies():
    rng = np.random.default_rng(0)
    truth = rng.random(40_000) < 0.2
    right = np.array([0.95, 0.8, 0.7, 0.9])
    votes = np.where(rng.random((len(truth), 4)) < right, np.where(truth, 1, -1)[:, None], np.where(truth, -1, 1)[:, None])
    votes[rng.random(votes.shape) < 0.3] = 0
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    m = rep.fit(patterns, counts.astype(float))
    assert abs(m.prior - 0.2) < 0.03 and np.abs(m.right_if_clean - right).max() < 0.05 and np.abs(m.right_if_repetitive - right).max() < 0.08
    p = m.posterior(votes)
    assert ((p > 0.5) == truth).mean() > 0.93
    assert m.posterior(np.zeros((1, 4), dtype=int))[0] == pytest.approx(m.prior)


def test_found_loses_no_repetitive_text(spark):
    d = texts(9)
    j = rep.judge(spark.createDataFrame(d, DOCS))
    assert j.documents.count() == len(d)
    got = sorted(r.doc for r in rep.repetitive(j).collect())
    words = [(i, (t or "").replace(".", "").split()) for i, t in d]
    assert got == sorted(i for i, w in words if w and brute(w) * 10 >= len(w) * 3)
    assert all(0 <= r.posterior <= 1 for r in j.documents.collect())


def test_empty_table_and_very_long_text(spark):
    df = spark.createDataFrame([], DOCS)
    assert rep.repetitive(rep.judge(df)).count() == 0 and rep.measure(df).count() == 0
    long = " ".join(f"w{i}" for i in range(200_000))
    r = rep.measure(spark.createDataFrame([(1, long + " " + long)], DOCS)).first()
    assert (r.n_words, r.repeated_words) == (400_000, 200_000)


def test_digits_are_numbers_of_every_kind(spark):
    """Garbled letters such as "Ã¼" hold a ¼ that belongs to its word; a page of the large tables was lost while it split one."""
    t = "fÃ¼r die wÃ¼rde x² y½z _a_ 7٣ Ⅷ"
    r = rep.measure(spark.createDataFrame([(1, t)], DOCS)).first()
    assert r.n_words == 8
    run = "eins zwei drei vier fÃ¼nf sechs sieben acht"
    text = " ".join([run, *(f"wÃ¼{i}" for i in range(22)), run])  # 8 of 38 words are repeated; 8 of 62 pieces if each ¼ splits
    r = rep.measure(spark.createDataFrame([(1, text)], DOCS)).first()
    assert (r.n_words, r.repeated_words) == (38, 8)
