"""Repetition inside a single document: measured shares, rules that vote or abstain, and their posterior by expectation-maximisation.

Each text gets the shares of its words in repeated runs and of its lines, sentences and paragraphs that repeat earlier ones, its
vocabulary and its commonest phrase. Rules turn these into votes: 1 repetitive, -1 clean, 0 abstain. How far a rule can be trusted is not
set by hand: EM estimates each rule's sensitivity and specificity and the share of repetitive texts from the counts of vote patterns. A
corpus of any size has at most 3^rules patterns, so that table is all the driver sees. The posterior of a text is that of its pattern.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.text import words
from tidemark.session import cut

RUN = 8
#: Words that are handled at once.
CHUNK = 1 << 20

MEASURES = ("n_words", "repeated_words", "distinct_words", "top_phrase", "line_share", "sentence_share", "paragraph_share", "n_lines", "n_sentences", "n_paragraphs")


def _windows(ids: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions where a run of n words of one document begins, ordered by document and run; whether each begins a new run; the order's documents."""
    if len(ids) < n:
        none = np.zeros(0, dtype=np.int64)
        return none, none.astype(bool), none
    at = np.flatnonzero(doc[: len(ids) - n + 1] == doc[n - 1 :])
    h = np.zeros(len(at), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            h = (h ^ (ids[at + k].astype(np.uint64) + np.uint64(1))) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    order = np.lexsort((h, doc[at]))  # stable: equal runs stay in order of position
    at, h = at[order], h[order]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[at[1:]] != doc[at[:-1]])
    return at, new, doc[at]


def _per_doc(doc: np.ndarray, n_docs: int, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(doc, weights=weights, minlength=n_docs).astype(np.int64)


def repeated_words(ids: np.ndarray, doc: np.ndarray, n_docs: int, run: int = RUN) -> np.ndarray:
    """Per document the words that lie in some run of ``run`` words equal to one that begins earlier in it. Runs are compared word by word."""
    at, new, _ = _windows(ids, doc, run)
    first = at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))] if len(at) else at
    again = ~new
    for k in range(run):
        again &= ids[at + k] == ids[first + k]
    edge = np.zeros(len(ids) + 1, dtype=np.int64)
    np.add.at(edge, at[again], 1)
    np.add.at(edge, at[again] + run, -1)
    return _per_doc(doc[np.cumsum(edge[:-1]) > 0], n_docs)


def top_phrase(ids: np.ndarray, doc: np.ndarray, n_docs: int, n: int = 3) -> np.ndarray:
    """Per document how often its commonest run of n words occurs; 0 without one."""
    _, new, of = _windows(ids, doc, n)
    out = np.zeros(n_docs, dtype=np.int64)
    if len(new):
        begins = np.flatnonzero(new)
        np.maximum.at(out, of[begins], np.diff(np.append(begins, len(new))))
    return out


def _pieces(texts: pa.Array, pattern: str) -> tuple[np.ndarray, np.ndarray]:
    """Per text the share of characters in pieces that equal an earlier piece, and the number of pieces. Blank pieces don't count."""
    parts = pc.split_pattern_regex(texts, pattern)
    doc = np.repeat(np.arange(len(texts)), pc.fill_null(pc.list_value_length(parts), 0).to_numpy(zero_copy_only=False))
    flat = pc.utf8_trim_whitespace(parts.flatten())
    size = pc.utf8_length(flat).to_numpy(zero_copy_only=False).astype(np.int64)
    ids = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    doc, ids, size = doc[size > 0], ids[size > 0], size[size > 0]
    order = np.lexsort((ids, doc))
    d, i = doc[order], ids[order]
    again = np.zeros(len(d), dtype=bool)
    again[1:] = (d[1:] == d[:-1]) & (i[1:] == i[:-1])
    total = _per_doc(doc, len(texts), size)
    return _per_doc(d[again], len(texts), size[order][again]) / np.maximum(total, 1), _per_doc(doc, len(texts))


def _measure(b: pa.RecordBatch) -> pa.RecordBatch:
    lists, texts = b.column("words"), b.column("text")
    n_docs = b.num_rows
    flat = lists.flatten()
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    doc = np.repeat(np.arange(n_docs), lengths)
    ids = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    distinct = _per_doc(np.unique(doc * (int(ids.max()) + 1 if len(ids) else 1) + ids) // (int(ids.max()) + 1 if len(ids) else 1), n_docs)
    (line, n_line), (sentence, n_sentence), (para, n_para) = (_pieces(texts, p) for p in (r"\n+", r"[.!?;]\s+|\n+", r"\n\s*\n"))
    cols = [lengths, repeated_words(ids, doc, n_docs), distinct, top_phrase(ids, doc, n_docs), line, sentence, para, n_line, n_sentence, n_para]
    return pa.RecordBatch.from_arrays([b.column("doc"), *(pa.array(c) for c in cols)], names=["doc", *MEASURES])


def measure(documents: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, measures): ``repeated_words`` of ``n_words``, ``distinct_words``, count of the commonest 3 words, shares and numbers of pieces.

    Whole texts are measured. A null text counts as empty: all measures are 0. One row per input row, whatever the ids. No shuffle: a
    document is measured where it is read; a task holds ``CHUNK`` words or one document at a time.
    """
    rows = documents.select(F.col(doc).alias("doc"), F.coalesce(words(F.col(text)), F.array().cast("array<string>")).alias("words"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            ends = np.cumsum(b.column("words").value_lengths().to_numpy(zero_copy_only=False))
            begin = 0
            while begin < b.num_rows:
                done = ends[begin - 1] if begin else 0
                end = max(begin + 1, int(np.searchsorted(ends, done + CHUNK, side="right")))
                yield _measure(b.slice(begin, end - begin))
                begin = end

    kinds = [T.DoubleType() if m.endswith("_share") else T.LongType() for m in MEASURES]
    return rows.mapInArrow(run, T.StructType([rows.schema["doc"], *(T.StructField(m, k) for m, k in zip(MEASURES, kinds))]))


# -- rules ------------------------------------------------------------------------------------------------------------------------


def _vote(share: Column, bad: float, good: float, enough: Column) -> Column:
    return F.when(~enough, 0).when(share >= bad, 1).when(share <= good, -1).otherwise(0)


def rules() -> dict[str, Column]:
    """Votes from the measures. ``runs`` votes 1 exactly where at least 3 in 10 words are repeated."""
    n = F.col("n_words")
    return {
        "runs": F.when(n < RUN, 0).when(F.col("repeated_words") * 10 >= n * 3, 1).when(F.col("repeated_words") * 20 <= n, -1).otherwise(0),
        "lines": _vote(F.col("line_share"), 0.3, 0.02, F.col("n_lines") >= 3),
        "sentences": _vote(F.col("sentence_share"), 0.3, 0.05, F.col("n_sentences") >= 4),
        "paragraphs": _vote(F.col("paragraph_share"), 0.3, 0.0, F.col("n_paragraphs") >= 3),
        "vocabulary": F.when(n < 50, 0).when(F.col("distinct_words") * 4 < n, 1).when(F.col("distinct_words") * 2 > n, -1).otherwise(0),
        "phrase": F.when(n < 30, 0).when(F.col("top_phrase") * 30 >= n, 1).when(F.col("top_phrase") * 90 <= n, -1).otherwise(0),
    }


@dataclass(frozen=True)
class LabelModel:
    """What EM found: the share of repetitive texts, and for each rule how often its votes are right on repetitive and on clean texts."""

    prior: float
    right_if_repetitive: np.ndarray
    right_if_clean: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """P(repetitive) of each row of votes; rules that abstain say nothing."""
        up, down = votes == 1, votes == -1
        bad = np.log(self.prior) + up @ np.log(self.right_if_repetitive) + down @ np.log1p(-self.right_if_repetitive)
        good = np.log1p(-self.prior) + down @ np.log(self.right_if_clean) + up @ np.log1p(-self.right_if_clean)
        return 1 / (1 + np.exp(np.clip(good - bad, -700, 700)))


#: Rounds of EM over a corpus' patterns: fixed, so that any engine that does as many gets the same model.
ROUNDS = 40


def fit(votes: np.ndarray, counts: np.ndarray, rounds: int = 200, tolerance: float = 1e-9) -> LabelModel:
    """Two-coin EM over vote patterns and how many texts have each, begun at the majority vote. Each rule's rates have a prior of five
    pseudo-votes, four of them right, and the share of repetitive texts one of two texts, one of each kind."""
    q = np.clip(0.5 + 0.4 * np.sign(votes.sum(axis=1)), 0.1, 0.9)
    model = None
    for _ in range(rounds):
        bad, good = counts * q, counts * (1 - q)
        up, down = votes == 1, votes == -1
        sens = (bad @ up + 4) / (bad @ (up | down) + 5)
        spec = (good @ down + 4) / (good @ (up | down) + 5)
        model = LabelModel(float((bad.sum() + 1) / (counts.sum() + 2)), sens, spec)
        new = model.posterior(votes)
        if tolerance and np.max(np.abs(new - q), initial=0) < tolerance:
            break
        q = new
    return model if model is not None else LabelModel(0.5, np.full(votes.shape[1], 0.8), np.full(votes.shape[1], 0.8))


@dataclass
class Judged:
    """``documents``: (doc, measures, votes, posterior); ``model``; ``patterns``: votes, counts and posteriors per pattern; ``names`` of the rules."""

    documents: DataFrame
    model: LabelModel
    names: list[str]
    votes: np.ndarray
    counts: np.ndarray
    posteriors: np.ndarray

    def least_posterior(self, rule: str) -> float:
        """The smallest posterior of any pattern in which ``rule`` votes 1: a candidate bound that loses none of that rule's texts."""
        own = self.posteriors[self.votes[:, self.names.index(rule)] == 1]
        return float(own.min()) if len(own) else 1.0


def judge(documents: DataFrame, doc: str = "doc_id", text: str = "text") -> Judged:
    """Measure every document, let the rules vote, fit the label model on all vote patterns and give each document its posterior.

    Documents in which every rule abstains (empty and very short texts) get the prior.
    """
    named = rules()
    voted = cut(measure(documents, doc, text).select("doc", *MEASURES, *(v.cast("int").alias(f"vote_{k}") for k, v in named.items())))
    cols = [f"vote_{k}" for k in named]
    patterns = voted.groupBy(*cols).agg(F.count(F.lit(1)).alias("n")).collect()  # at most 3^rules rows
    votes = np.array([[r[c] for c in cols] for r in patterns], dtype=np.int64).reshape(-1, len(cols))
    counts = np.array([r["n"] for r in patterns], dtype=float)
    model = fit(votes, counts, ROUNDS, 0.0)
    posteriors = model.posterior(votes)
    rows = [(*map(int, v), float(p)) for v, p in zip(votes, posteriors)]
    known = documents.sparkSession.createDataFrame(rows, ", ".join(f"{c} int" for c in cols) + ", posterior double")
    return Judged(voted.join(F.broadcast(known), cols), model, list(named), votes, counts, posteriors)


def repetitive(judged: Judged) -> DataFrame:
    """(doc, repeated_share, posterior) of the documents of whose words at least 3 in 10 are repeated: candidates by posterior, then the exact share.

    The bound on the posterior is the smallest that any text with that share has, so no such text is lost.
    """
    at_least = judged.least_posterior("runs") * (1 - 1e-12)
    found = judged.documents.where((F.col("posterior") >= at_least) & (F.col("n_words") > 0) & (F.col("repeated_words") * 10 >= F.col("n_words") * 3))
    return found.select("doc", (F.col("repeated_words") / F.col("n_words")).alias("repeated_share"), "posterior")
