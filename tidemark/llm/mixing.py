"""Mix sources to target weights: capped water-filling, then seeded whole and fractional repetitions."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.text import size as text_size
from tidemark.session import cut

#: Steps of the unit interval in which a source's documents are ordered for a fractional repetition.
STEPS = 1024
#: Sources are configuration: the table of targets is read by the driver, up to this many rows.
MAX_SOURCES = 10_000


@dataclass(frozen=True)
class Share:
    """One source's part of the mix. ``short``: it can't reach its target share of the whole even at ``max_repeats``."""

    source: str
    target: float
    max_repeats: int
    available: int
    short: bool
    amount: float

    @property
    def repeats(self) -> float:
        return self.amount / self.available if self.available else 0.0


def water_fill(targets: list[tuple[str, float, int]], available: dict[str, int], total: float | None = None) -> list[Share]:
    """Split ``total`` (the size of all listed sources if None) by weight, no source beyond ``max_repeats`` times what it has.

    Sources whose part exceeds their cap are clamped to it and the rest is split again among the others in proportion to their weights,
    until no part exceeds its cap or all sources are clamped; then the mix is smaller than ``total``. Null, zero or negative
    weights and caps get nothing.
    """
    total = float(sum(available.get(s, 0) for s, _, _ in targets)) if total is None else total
    weight = {s: max(0.0, w or 0.0) for s, w, _ in targets}
    cap = {s: max(0, r or 0) * available.get(s, 0) for s, _, r in targets}
    amount: dict[str, float] = {}
    open_ = [s for s, _, _ in targets if weight[s] > 0]
    left = total
    while open_:
        scale = left / math.fsum(weight[s] for s in open_)
        over = [s for s in open_ if weight[s] * scale > cap[s]]
        if not over:
            amount |= {s: weight[s] * scale for s in open_}
            break
        for s in over:
            amount[s] = float(cap[s])
        left = max(0.0, total - math.fsum(amount.values()))
        open_ = [s for s in open_ if s not in amount]
    return [Share(s, weight[s], max(0, r or 0), available.get(s, 0), weight[s] * total > cap[s], amount.get(s, 0.0)) for s, _, r in targets]


def source_key(source: Column) -> Column:
    """Sources are compared without the white space around them and in lower case."""
    return F.lower(F.regexp_replace(source, r"^\p{IsWhite_Space}+|\p{IsWhite_Space}+$", ""))


class Mixer:
    """A mix of ``documents`` to ``targets`` (source, target_share, max_repeats).

    Documents without a source, or of one that isn't listed, take no part. A null text has size 0. Targets whose names are
    equal after trimming and lowering are refused. ``size`` gives the size of a text: words and other characters by default,
    or :func:`tokenizer_size` for the tokens of a public tokenizer.
    """

    def __init__(self, documents: DataFrame, targets: DataFrame, *, doc: str = "doc_id", source: str = "source", text: str = "text", seed: int = 7, total: float | None = None, size: Callable[[Column], Column] = text_size):
        rows = targets.select("source", source_key(F.col("source")).alias("k"), "target_share", "max_repeats").limit(MAX_SOURCES + 1).collect()
        rows = [r for r in rows if r["k"] is not None]
        if len(rows) > MAX_SOURCES or len({r["k"] for r in rows}) < len(rows):
            raise ValueError("targets: too many sources, or one source twice")
        self.spark, self.seed = documents.sparkSession, seed
        self.names = {r["k"]: r["source"] for r in rows}
        self.listed = F.broadcast(self.spark.createDataFrame([(k,) for k in self.names], "source string"))
        hashed = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc).cast("string"), F.lit("null"))))
        u = F.conv(F.substring(hashed, 1, 13), 16, 10).cast("bigint").cast("double") * 2.0**-52  # even over [0, 1), the same on any engine
        self.sized = cut(documents.select(F.col(doc).alias("doc"), source_key(F.col(source)).alias("source"), size(F.col(text)).alias("size"), u.alias("u")).join(self.listed, "source", "left_semi"))
        # combined before any shuffle: at most STEPS rows a source and task
        step = F.floor(F.col("u") * STEPS).cast("int")
        self.steps = cut(self.sized.groupBy("source", step.alias("step")).agg(F.sum("size").alias("size")))
        available = {k: 0 for k in self.names} | {r["source"]: r["n"] for r in self.steps.groupBy("source").agg(F.sum("size").alias("n")).collect()}  # a row per target
        self.shares = water_fill([(r["k"], r["target_share"], r["max_repeats"]) for r in rows], available, total)

    def thresholds(self) -> DataFrame:
        """(source, whole, below): whole repetitions, and the u below which a document is taken once more, where the sizes in order of u
        reach the rest: the step in which they do is found by running sums over a source's ``STEPS`` steps, and divided evenly."""
        cuts = []
        for s in self.shares:
            whole = min(s.max_repeats, math.floor(s.repeats))
            rest = s.amount - whole * s.available
            cuts.append((s.source, whole, float(rest) if rest > 0 and whole < s.max_repeats else 0.0))
        wanted = F.broadcast(self.spark.createDataFrame(cuts, "source string, whole int, rest double"))  # a row per target
        run = F.sum("size").over(Window.partitionBy("source").orderBy("step"))
        reach = self.steps.where(F.col("size") > 0).withColumn("run", run).join(wanted.select("source", "rest"), "source").where((F.col("rest") > 0) & (F.col("run") >= F.col("rest")))
        first = reach.groupBy("source").agg(F.min(F.struct("step", "run", "size", "rest")).alias("s"))
        inside = (F.col("s.step") + (F.col("s.rest") - (F.col("s.run") - F.col("s.size"))) / F.col("s.size")) / STEPS
        at = wanted.join(first.select("source", inside.alias("inside")), "source", "left")
        return at.select("source", "whole", F.when(F.col("rest") > 0, F.coalesce("inside", F.lit(1.0))).otherwise(0.0).alias("below"))

    def plan(self) -> DataFrame:
        """(source, target_share, max_repeats, available, amount, repeats, short): one row per target, named as given."""
        rows = [(self.names[s.source], s.target, s.max_repeats, s.available, s.amount, s.repeats, s.short) for s in self.shares]
        return self.spark.createDataFrame(rows, "source string, target_share double, max_repeats int, available bigint, amount double, repeats double, short boolean")

    def chosen(self) -> DataFrame:
        """(doc, source, copy, size): a row for each copy taken, ``copy`` from 1. The same seed takes the same copies, in any partitioning."""
        at = F.broadcast(self.thresholds())  # a row per target
        n = F.col("whole") + F.when(F.col("u") < F.col("below"), 1).otherwise(0)
        taken = self.sized.join(at, "source").withColumn("n", n).where(F.col("n") > 0)
        return taken.select("doc", "source", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"), "size")

    def reached(self) -> DataFrame:
        """(source, target_share, copies, size, share): the shares actually reached by :meth:`chosen`; one row per target."""
        got = self.chosen().groupBy("source").agg(F.count(F.lit(1)).alias("copies"), F.sum("size").alias("size"))
        listed = self.spark.createDataFrame([(k, n) for k, n in self.names.items()], "source string, name string")
        plan = self.spark.createDataFrame([(s.source, s.target) for s in self.shares], "source string, target_share double")
        rows = plan.join(listed, "source").join(got, "source", "left").select(F.col("name").alias("source"), "target_share", F.coalesce("copies", F.lit(0)).alias("copies"), F.coalesce("size", F.lit(0)).alias("size"))
        rows = cut(rows)  # a row per target
        total = rows.agg(F.sum("size")).scalar()
        return rows.select(*rows.columns, F.when(total > 0, F.col("size") / total).otherwise(F.lit(0.0)).alias("share"))


def tokenizer_size(path: str) -> Callable[[Column], Column]:
    """Sizes in tokens of a public tokenizer: a .json file for ``tokenizers``, a .model file for ``sentencepiece``. Strings of special tokens are ordinary text."""

    @F.pandas_udf("bigint")
    def count(texts: pd.Series) -> pd.Series:
        present = texts.notna()
        own = texts[present].tolist()
        if path.endswith(".model"):
            import sentencepiece

            n = [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=path).encode(own, num_threads=1)]
        else:
            from tokenizers import Tokenizer

            tok = Tokenizer.from_file(path)
            tok.encode_special_tokens = True
            n = [len(x.ids) for x in tok.encode_batch(own, add_special_tokens=False)]
        out = pd.Series(0, index=texts.index, dtype="int64")
        out[present] = n
        return out

    return count
