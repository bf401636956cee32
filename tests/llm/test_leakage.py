"""Leaks against a word-by-word search."""

import random
import re

import pytest

from tidemark.llm import leakage


def brute(docs, items, window=13):
    w = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    out = set()
    for d, t in docs:
        dw = w(t)
        for i, it in items:
            iw = w(it)
            n = min(window, len(iw))
            if n and any(dw[a : a + n] == iw[s : s + n] for s in range(len(iw) - n + 1) for a in range(len(dw) - n + 1)):
                out.add((d, i))
    return out


def case(seed):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(12)] + ["Été", "straße", "x9"]
    text = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    items = [(i, text(rnd.choice([0, 1, 3, 5, 9, 12, 13, 14, 40]))) for i in range(25)] + [(100, None), (101, "..."), (3, None)]
    docs = []
    for d in range(40):
        it = rnd.choice(items)[1] or ""
        words = it.split()
        a = rnd.randint(0, max(0, len(words) - 13))
        part = words[a : a + rnd.choice([12, 13, 20])]
        docs.append((d, text(rnd.randint(0, 30)) + " -- " + "; ".join(part).upper() + "\n" + text(rnd.randint(0, 30))))
    return docs + [(900, None), (901, ""), (902, "?!"), (0, docs[0][1])], items


@pytest.mark.parametrize(("seed", "rows"), [(0, 200_000), (1, 0), (2, 250)])
def test_pairs_match_brute_force(spark, seed, rows):
    docs, items = case(seed)
    d = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "1 as words", "2 as h", "3 as item", "4 as start")
    i = spark.createDataFrame(items, "item_id bigint, text string").selectExpr("*", "1 as w", "2 as doc")
    got = {(r.doc, r.item) for r in leakage.matched_windows(d, i, max_broadcast_rows=rows).collect()}
    assert got == brute(docs, items)


def test_coverage(spark):
    item = " ".join(f"t{i}" for i in range(20))
    docs = spark.createDataFrame([(1, item), (2, "pre " + " ".join(item.split()[3:17]) + " post"), (3, " ".join(item.split()[:12]))], "doc_id bigint, text string")
    got = {r.doc: (r.windows, r.item_windows, r.share) for r in leakage.leaks(docs, spark.createDataFrame([(7, item)], "item_id bigint, text string")).collect()}
    assert got == {1: (8, 8, 1.0), 2: (2, 8, 0.25)}


def test_empty_tables(spark):
    d, i = spark.createDataFrame([(1, "a b c")], "doc_id bigint, text string"), spark.createDataFrame([(1, "a b c")], "item_id bigint, text string")
    assert leakage.matched_windows(d.limit(0), i).count() == 0
    assert leakage.matched_windows(d, i.limit(0)).count() == 0
    assert leakage.matched_windows(d, i).count() == 1


def test_very_long_text(spark):
    item = " ".join(f"q{i}" for i in range(30))
    long = "lorem ipsum dolor " * 60_000 + item
    assert [(r.doc, r.start) for r in leakage.matched_windows(spark.createDataFrame([(1, long)], "doc_id bigint, text string"), spark.createDataFrame([(1, item)], "item_id bigint, text string")).orderBy("start").collect()] == [(1, s) for s in range(18)]
