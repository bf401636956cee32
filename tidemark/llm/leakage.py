"""Evaluation texts leaking into a corpus: prefix-filtered set join over word shingles, verified exactly over item-sized windows.

A document contains a passage of an item if some ``window`` consecutive words of the item (all words of a shorter one) occur in it
in a row. Such a window consists of shingles of ``shingle`` words, all of which the document must contain. So it is enough
to look the document's shingles up against a prefix of the item's: of each window the one shingle that is rarest in the corpus. A match
fixes where the window must begin; the bounds of the document rule out windows that don't fit, and the others are compared word by
word. The rarity is counted over the whole corpus, not sampled.

Items are the stated query set, met by every document. The corpus is read and cut into words once: what meets a shingle of the items is
kept with the words around it, and counted, joined to the prefixes and verified there. The items' shingles are broadcast in blocks of
checked size; for more than ``MAX_BLOCKS`` of these both sides are shuffled by shingle, and only pages with a prefix are read again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.text import words
from tidemark.session import broadcast_within, cut

WINDOW = 13
SHINGLE = 5
#: Broadcast blocks of item shingles, each of which costs a pass over the corpus.
MAX_BLOCKS = 4


def _shingle_at(tokens: Column, at: Column, n: int) -> Column:
    """The hash of ``n`` words from 0-based position ``at``; only meaningful where they exist."""
    return F.xxhash64(F.lit(n), *(F.get(tokens, at + i) for i in range(n)))


def _document_shingles(docs: DataFrame, sizes: list[int]) -> DataFrame:
    """(doc, words, at, h): every shingle of each of the sizes at every position, streamed within the scan's stage."""
    # outer, as else the optimiser infers a filter from the generator and extracts the words twice
    spots = docs.select("doc", "words", F.posexplode_outer("words").alias("at", "__w"))
    n = F.size("words")
    if len(sizes) == 1:
        return spots.where(F.col("at") + sizes[0] <= n).select("doc", "words", "at", _shingle_at(F.col("words"), F.col("at"), sizes[0]).alias("h"))
    hashes = [F.when(F.col("at") + k <= n, _shingle_at(F.col("words"), F.col("at"), k)) for k in sizes]
    return spots.select("doc", "words", "at", F.explode(F.array(*hashes)).alias("h")).where(F.col("h").isNotNull())


def item_windows(items: DataFrame, item: str, text: str, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """(wid, item, start, window, size): every window of every item under an id of its own, with the size of its shingles. Items without words have none."""
    w = items.select(F.col(item).alias("item"), words(F.col(text)).alias("w")).where(F.size("w") > 0)
    n = F.size("w")
    length = F.least(F.lit(window), n)
    starts = w.select("item", "w", length.alias("len"), F.explode(F.sequence(F.lit(0), n - length)).alias("start"))
    return starts.select(F.monotonically_increasing_id().alias("wid"), "item", "start", F.slice("w", F.col("start") + 1, F.col("len")).alias("window"), F.least(F.lit(shingle), F.col("len")).alias("size"))


def window_shingles(windows: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(wid, of, k, h): each shingle of a window, at offset k, of ``of`` there are."""
    spots = windows.select("wid", "window", "size", F.explode(F.sequence(F.lit(0), F.size("window") - F.col("size"))).alias("k"))
    h = F.lit(None).cast("bigint")
    for n in range(1, shingle + 1):
        h = F.when(F.col("size") == n, _shingle_at(F.col("window"), F.col("k"), n)).otherwise(h)
    return spots.select("wid", (F.size("window") - F.col("size") + 1).alias("of"), "k", h.alias("h"))


def matched_windows(documents: DataFrame, items: DataFrame, *, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, shingle: int = SHINGLE, max_broadcast_rows: int = 200_000) -> DataFrame:
    """(doc, item, start): each window of an item that a document contains, once per document.

    Words are runs of letters and digits in lower case. Null and empty texts contain nothing; an item without words is in no
    document. Whole texts are read. Equal document ids count as one document each time they occur; equal item ids are one item.
    """
    windows = cut(item_windows(items, item, item_text, window, shingle))
    sizes = [r[0] for r in windows.select("size").distinct().orderBy("size").collect()]  # at most ``shingle`` different
    docs = documents.select(F.col(doc).alias("doc"), words(F.col(text)).alias("words"))
    if not sizes:
        return docs.join(windows, F.lit(False)).select("doc", "item", "start")
    shingles = cut(window_shingles(windows, shingle))
    known = cut(shingles.select("h").distinct())
    blocks = -(-known.count() // max_broadcast_rows) if max_broadcast_rows else MAX_BLOCKS + 1
    spots = _document_shingles(docs, sizes)
    lo = F.greatest(F.lit(0), F.col("at") - (window - 1))
    if blocks <= MAX_BLOCKS:
        around = [(F.col("at") - lo).alias("at"), F.slice("words", lo + 1, F.lit(2 * window - 1)).alias("near")]
        block = F.pmod(F.xxhash64("h"), F.lit(max(1, blocks)))
        parts = [spots.join(F.broadcast(known.where(block == i)), "h").select("doc", "h", *around) for i in range(max(1, blocks))]
        hits = cut(reduce(lambda a, b: a.unionByName(b), parts))
    else:  # rows of a shingle that a large part of the corpus has are split by AQE
        hits = cut(spots.select("doc", "h", "at").join(known, "h"))
    counted = hits.groupBy("h").agg(F.count(F.lit(1)).alias("times"))
    # a shingle that is nowhere in the corpus: its windows are in no document
    rarest = shingles.join(counted, "h").groupBy("wid").agg(F.count(F.lit(1)).alias("present"), F.max("of").alias("of"), F.min(F.struct("times", "h", "k")).alias("r"))
    prefix = cut(rarest.where(F.col("present") == F.col("of")).join(windows, "wid").select("r.h", "r.k", "item", "start", "window"))
    begin = F.col("at") - F.col("k")
    if blocks <= MAX_BLOCKS:
        met = hits.join(broadcast_within(prefix, max_broadcast_rows), "h")
    else:
        begins = hits.join(prefix, "h").where(begin >= 0)
        met = docs.join(begins, "doc").withColumnRenamed("words", "near")
    inside = met.where((begin >= 0) & (begin + F.size("window") <= F.size("near")))
    found = inside.where(F.slice("near", begin + 1, F.size("window")) == F.col("window"))
    return found.select("doc", "item", "start").distinct()


def leaks(documents: DataFrame, items: DataFrame, **names) -> DataFrame:
    """(doc, item, windows, item_windows, share): how many windows of the item the document contains, of how many."""
    matched = matched_windows(documents, items, **names)
    item, text, window = names.get("item", "item_id"), names.get("item_text", "text"), names.get("window", WINDOW)
    n = F.size(words(F.col(text)))
    of = items.select(F.col(item).alias("item"), F.greatest(F.lit(1), n - window + 1).alias("item_windows")).groupBy("item").agg(F.max("item_windows").alias("item_windows"))
    pairs = matched.groupBy("doc", "item").agg(F.count_distinct("start").alias("windows"))
    return pairs.join(of, "item").select("doc", "item", "windows", F.col("item_windows").cast("bigint").alias("item_windows"), (F.col("windows") / F.col("item_windows")).alias("share"))
