"""Process only what is new or changed: Merkle trees over key ranges, and output that is published together with its tree.

Two kinds of table are handled. *Numbered* records (spaces such as topic and partition, and a number) are kept as words of 64 numbers,
one bit each, so repeated deliveries don't change a digest. *Keyed* records are kept as hashes of key and content, so changed and removed
records show as well. A leaf is a range of hashes: of a space and its stretch of 4096 numbers, or of a key. A node's digest combines its
children's. The tree that the last run published is compared with that of now from the root, descending only below nodes whose digests
differ; what the last run had is read from the differing leaves' files alone, and only these are written again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import cut, side_by_side

WORD_BITS = 6  # numbers of a word: 64
LEAF_BITS = 12  # numbers of a leaf: 4096
FAN_BITS = 8  # children of a node: 256


# -- trees -----------------------------------------------------------------------------------------------------------------------


def _digest(*parts: Column) -> Column:
    """Of an unordered set of distinct children: each hashed with its place, combined by xor; algebraic, so combined map-side."""
    return F.bit_xor(F.xxhash64(*parts))


def tree(leaves: DataFrame, spaces: tuple[str, ...], levels: int) -> DataFrame:
    """(spaces, level, node, digest) from level 0, ``leaves`` (spaces, node, digest), to level ``levels``."""
    level, out = leaves.select(*spaces, F.lit(0).alias("level"), "node", "digest"), None
    for k in range(levels + 1):
        out = level if out is None else out.unionByName(level)
        level = level.groupBy(*spaces, F.shiftright("node", FAN_BITS).alias("parent")).agg(_digest(F.col("node"), F.col("digest")).alias("digest"))
        level = level.select(*spaces, F.lit(k + 1).alias("level"), F.col("parent").alias("node"), "digest")
    return out


def levels_for(leaves: DataFrame) -> int:
    """Levels above the leaves until each space has one node (two where numbers are negative as well)."""
    lo, hi = leaves.agg(F.min("node"), F.max("node")).first()
    most = max(hi, -lo - 1, 0) if hi is not None else 0
    return -(-most.bit_length() // FAN_BITS)


def _meet(left: DataFrame, right: DataFrame, spaces: tuple[str, ...], extra: str, how: str) -> DataFrame:
    """Join with ``right``'s columns renamed r_*; spaces meet null-safely, ``extra`` is a further SQL condition over both."""
    cond = F.expr(extra)
    for c in spaces:
        cond = cond & F.col(c).eqNullSafe(F.col(f"r_{c}"))
    return left.join(right.select(*(F.col(c).alias(f"r_{c}") for c in right.columns)), cond, how)


def changed_leaves(now: DataFrame, saved: DataFrame, spaces: tuple[str, ...], levels: int) -> DataFrame:
    """(spaces, node) of the leaves that differ between two trees of equal ``levels``, found from the root downwards."""
    frontier: DataFrame | None = None
    for level in range(levels, -1, -1):
        sides = []
        for t in (now, saved):
            side = t.where(F.col("level") == level).select(*spaces, "node", "digest")
            if frontier is not None:
                side = _meet(side, frontier, spaces, f"shiftright(node, {FAN_BITS}) = r_node", "left_semi")
            sides.append(side)
        both = _meet(sides[0], sides[1], spaces, "node = r_node", "full_outer")
        in_now = F.col("node").isNotNull()
        differing = both.where(~F.col("digest").eqNullSafe(F.col("r_digest"))).select(*(F.when(in_now, F.col(c)).otherwise(F.col(f"r_{c}")).alias(c) for c in (*spaces, "node")))
        frontier = cut(differing) if level else differing  # both sides of the next level read it
    return frontier


# -- numbered records ------------------------------------------------------------------------------------------------------------


def words(records: DataFrame, spaces: tuple[str, ...], number: str) -> DataFrame:
    """(spaces, word, bits): which numbers occur, each once however often it was delivered. Null numbers have no bit."""
    n = F.col(number).cast("bigint")
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), n.bitwiseAND(63).cast("int"))
    return records.where(F.col(number).isNotNull()).groupBy(*spaces, F.shiftright(n, WORD_BITS).alias("word")).agg(F.bit_or(bit).alias("bits"))


def merge_words(parts: DataFrame, spaces: tuple[str, ...]) -> DataFrame:
    return parts.groupBy(*spaces, "word").agg(F.bit_or("bits").alias("bits"))


def word_leaves(w: DataFrame, spaces: tuple[str, ...]) -> DataFrame:
    return w.where(F.col("bits") != 0).groupBy(*spaces, F.shiftright("word", LEAF_BITS - WORD_BITS).alias("node")).agg(_digest(F.col("word"), F.col("bits")).alias("digest"))


def upto(w: DataFrame, offsets: DataFrame, spaces: tuple[str, ...], saved: str) -> DataFrame:
    """Of ``w`` the numbers up to the saved one of their space (null or no row: none): what a run that saved these had processed."""
    place = F.col(saved) - F.shiftleft(F.col("word"), WORD_BITS)  # of the saved number in this word
    all_, none = F.lit(-1).cast("bigint"), F.lit(0).cast("bigint")
    some = F.bitwise_not(F.call_function("shiftleft", all_, (place + 1).cast("int")))
    low = F.when(place >= 63, all_).when(place >= 0, some).otherwise(none)
    return w.join(offsets.select(*spaces, saved), list(spaces)).select(*spaces, "word", F.col("bits").bitwiseAND(low).alias("bits")).where(F.col("bits") != 0)


def fresh_numbers(now: DataFrame, saved: DataFrame, spaces: tuple[str, ...], number: str) -> DataFrame:
    """(spaces, number): the numbers in the words ``now`` but not in the words ``saved``."""
    both = _meet(now, saved, spaces, "word = r_word", "left")
    fresh = both.select(*spaces, "word", F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("r_bits", F.lit(0).cast("bigint")))).alias("fresh")).where(F.col("fresh") != 0)
    each = fresh.select(*spaces, "word", "fresh", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("i")).where(F.expr("shiftrightunsigned(fresh, i) & 1") == 1)
    return each.select(*spaces, (F.shiftleft(F.col("word"), WORD_BITS) + F.col("i")).alias(number))


def new_numbers(now: DataFrame, saved: DataFrame, spaces: tuple[str, ...], number: str = "offset") -> DataFrame:
    """(spaces, number): the numbers in ``now`` (words) but not in ``saved`` (words), read from the leaves that differ only."""
    a, b = word_leaves(now, spaces), word_leaves(saved, spaces)
    levels = levels_for(a)
    leaves = changed_leaves(cut(tree(a, spaces, levels)), cut(tree(b, spaces, levels)), spaces, levels)
    side = _meet(now, leaves, spaces, f"shiftright(word, {LEAF_BITS - WORD_BITS}) = r_node", "left_semi").select(*spaces, "word", "bits")
    return fresh_numbers(side, saved, spaces, number)


# -- keyed records ---------------------------------------------------------------------------------------------------------------


def key_hash(keys: tuple[str, ...]) -> Column:
    return F.xxhash64(*(F.col(k) for k in keys))


def key_index(records: DataFrame, keys: tuple[str, ...], content: tuple[str, ...], leaf_bits: int = 16) -> DataFrame:
    """(node, key_hash, row_hash): one row per key; ``node`` is the range of the key's hash. Several rows of a key combine into one hash.

    The key hash is 64 bits wide and salted with a second hash in ``row_hash``'s place, so two keys that share one show as a change.
    """
    row = F.xxhash64(F.lit(7), *(F.col(c) for c in (*keys, *content)))
    distinct = records.select(key_hash(keys).alias("key_hash"), row.alias("row_hash")).groupBy("key_hash", "row_hash").agg(F.count(F.lit(1)).alias("n"))
    per_key = distinct.groupBy("key_hash").agg(F.bit_xor(F.xxhash64("row_hash", "n")).alias("row_hash"))
    return per_key.select(F.shiftrightunsigned("key_hash", 64 - leaf_bits).alias("node"), "key_hash", "row_hash")


def index_leaves(index: DataFrame) -> DataFrame:
    return index.groupBy("node").agg(_digest(F.col("key_hash"), F.col("row_hash")).alias("digest"))


def compare_indexes(now: DataFrame, saved: DataFrame) -> DataFrame:
    """(key_hash, change): ``added``, ``changed`` or ``removed`` between two key indexes."""
    b = saved.select("key_hash", F.col("row_hash").alias("s_row_hash"))
    both = now.join(b, "key_hash", "full_outer").where(~F.col("row_hash").eqNullSafe(F.col("s_row_hash")))
    return both.select("key_hash", F.when(F.col("s_row_hash").isNull(), "added").when(F.col("row_hash").isNull(), "removed").otherwise("changed").alias("change"))


def record_changes(now: DataFrame, saved: DataFrame, leaf_bits: int = 16) -> DataFrame:
    """:func:`compare_indexes`, looked up in the leaves that differ only."""
    levels = -(-leaf_bits // FAN_BITS)
    leaves = changed_leaves(cut(tree(index_leaves(now), (), levels)), cut(tree(index_leaves(saved), (), levels)), (), levels)
    return compare_indexes(now.join(leaves, "node", "left_semi"), saved.join(leaves, "node", "left_semi"))


# -- publishing ------------------------------------------------------------------------------------------------------------------


@dataclass
class RunStore:
    """A folder of runs. A run's outputs and state are written under a fresh name and count only once its commit file exists.

    The commit file ``commits/<n>.json`` is created by a rename that fails if the target exists, so of two writers one wins. That is one
    step on HDFS and file systems like it. A local file system looks for the target before it renames, so there and on object stores
    (which copy) two writers at once need a lock outside; one writer at a time is safe everywhere. What a failed run left is never read.

    A part of the state is one table, or is kept in buckets: then a run writes the buckets that it changed and its commit goes on naming
    the others where they are. State that the last ``keep`` commits don't name is deleted; outputs stay. There are 2^``bucket_bits``
    buckets: more of them let a run read and write less of a large state, at more files; 8 bits are the most.
    """

    spark: SparkSession
    path: str
    keep: int = 2
    bucket_bits: int = 3

    def _fs(self):
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        return jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(conf), jvm.org.apache.hadoop.fs.Path

    def _rename_new(self, draft, final) -> None:
        """Rename that fails if the target exists."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        none = self.spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 0)
        conf = self.spark._jsc.hadoopConfiguration()
        uri = final.toUri() if final.toUri().getScheme() else final.getFileSystem(conf).getUri()
        hadoop.FileContext.getFileContext(uri, conf).rename(draft, final, none)

    def commit(self, run: int) -> dict | None:
        fs, Path = self._fs()
        at = Path(f"{self.path}/commits/{run}.json")
        if not fs.exists(at):
            return None
        stream = fs.open(at)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def last(self) -> dict | None:
        """The newest commit: its number, tag, and the paths of its outputs and parts of the state; None before the first."""
        fs, Path = self._fs()
        folder = Path(f"{self.path}/commits")
        if not fs.exists(folder):
            return None
        names = [str(s.getPath().getName()) for s in fs.listStatus(folder)]
        done = [int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()]
        return self.commit(max(done)) if done else None

    def output(self, name: str = "output", commit: dict | None = None) -> DataFrame:
        commit = commit or self.last()
        return self.spark.read.parquet(commit["outputs"][name])

    def state(self, name: str = "state", buckets: Sequence[int] | None = None, commit: dict | None = None) -> DataFrame | None:
        """A part of the state, of the given buckets only; None before the first run, and where none of the buckets holds anything."""
        commit = commit or self.last()
        at = commit["parts"].get(name) if commit else None
        if isinstance(at, dict):
            at = list(at.values()) if buckets is None else [at[str(b)] for b in buckets if str(b) in at]
        return self.spark.read.parquet(*([at] if isinstance(at, str) else at)) if at else None

    def publish(self, output: DataFrame, state: DataFrame) -> dict:
        return self.publish_parts({"output": output}, {"state": state})

    def publish_parts(
        self, outputs: dict[str, DataFrame], state: dict[str, DataFrame], tag: int | None = None, query: str | None = None,
        draft: Draft | None = None,
    ) -> dict:
        """Write several outputs and parts of the state, then commit them together, and with them what was written to ``draft`` before.
        ``tag`` and ``query`` are kept in the commit."""
        draft = draft or self.draft()
        run, folder = draft.run, draft.folder
        commit = {"run": run, "tag": run if tag is None else tag, "query": query}
        commit["outputs"] = {**draft.outputs, **{k: f"{folder}/{k}" for k in outputs}}
        commit["parts"] = {**draft.parts, **{k: f"{folder}/state-{k}" for k in state}}
        for k, df in outputs.items():
            df.write.parquet(commit["outputs"][k])
        for k, df in state.items():
            df.write.parquet(commit["parts"][k])
        fs, Path = self._fs()
        fs.mkdirs(Path(f"{self.path}/commits"))
        written, final = Path(f"{folder}/commit"), Path(f"{self.path}/commits/{run}.json")
        stream = fs.create(written, True)
        stream.write(bytearray(json.dumps(commit), "utf-8"))
        stream.close()
        try:
            self._rename_new(written, final)
        except Py4JJavaError as e:
            if not fs.exists(final):
                raise
            raise RuntimeError(f"run {run} was committed by another writer") from e
        self._forget(run)
        return commit

    def draft(self) -> Draft:
        """The place of the next run."""
        last = self.last()
        run = last["run"] + 1 if last else 1
        return Draft(self, last, run, f"{self.path}/runs/{run}-{uuid.uuid4().hex[:12]}")

    def _forget(self, run: int) -> None:
        """Delete the state that only the commit before the last ``keep`` names."""
        old = self.commit(run - self.keep)
        if not old:
            return
        paths = lambda c: {p for part in c["parts"].values() for p in (part.values() if isinstance(part, dict) else [part])}
        named = set().union(*(paths(c) for n in range(run - self.keep + 1, run + 1) if (c := self.commit(n))))
        fs, Path = self._fs()
        for p in paths(old) - named:
            fs.delete(Path(p), True)


@dataclass
class Draft:
    """A run that isn't committed yet: tables can be written to it and read again before it is."""

    store: RunStore
    last: dict | None
    run: int
    folder: str
    outputs: dict[str, str] = field(default_factory=dict)
    parts: dict[str, dict[str, str]] = field(default_factory=dict)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write an output now; it counts once the run is committed."""
        self.outputs[name] = f"{self.folder}/{name}"
        df.write.parquet(self.outputs[name])
        return self.store.spark.read.parquet(self.outputs[name])

    def keep_buckets(self, df: DataFrame, name: str, replaced: Sequence[int]) -> DataFrame:
        """Write a part of the state that is kept in buckets: ``df`` has a column ``bucket`` and all rows of the buckets that it replaces.
        A large bucket is written by several tasks, small ones together by one."""
        at, there = f"{self.folder}/state-{name}", []
        if replaced:
            df.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(at)
            fs, Path = self.store._fs()
            there = [n for s in fs.listStatus(Path(at)) if (n := str(s.getPath().getName())).startswith("bucket=")]
        before = self.last["parts"].get(name, {}) if self.last else {}
        fresh = {n.split("=")[1]: f"{at}/{n}" for n in there}
        self.parts[name] = {b: p for b, p in before.items() if int(b) not in set(replaced)} | fresh
        return self.store.spark.read.schema(df.drop("bucket").schema).parquet(*fresh.values()) if fresh else df.drop("bucket").limit(0)


# -- runs ------------------------------------------------------------------------------------------------------------------------

LEVELS = 2  # of a saved tree: 65536 leaves under 256 nodes under the root
LEAVES_BITS = LEVELS * FAN_BITS


def _position(spaces: tuple[str, ...]) -> Column:
    """The leaf of a word: 16 bits of the hash of its space and its stretch of 4096 numbers."""
    return F.shiftrightunsigned(F.xxhash64(*spaces, F.shiftright("word", LEAF_BITS - WORD_BITS)), 64 - LEAVES_BITS)


def _bucket(store: RunStore) -> Column:
    """The bucket of a leaf: the leading bits of its place."""
    return F.shiftright("node", LEAVES_BITS - store.bucket_bits).cast("int")


def _word_digests(w: DataFrame, spaces: tuple[str, ...]) -> DataFrame:
    return w.where(F.col("bits") != 0).groupBy("node").agg(_digest(*(F.col(c) for c in spaces), F.col("word"), F.col("bits")).alias("digest"))


def _whole_tree(leaves: DataFrame) -> DataFrame:
    """The tree over at most 65536 written leaves: so few that one task does it without a shuffle."""
    return tree(leaves.coalesce(1), (), LEVELS)


def _new_tree(saved: DataFrame | None, changed: DataFrame, leaves: DataFrame) -> DataFrame:
    """The tree with the digests of ``changed`` leaves replaced by those of ``leaves``; the levels above follow."""
    if saved is not None:
        leaves = leaves.unionByName(saved.where(F.col("level") == 0).select("node", "digest").join(F.broadcast(changed), "node", "left_anti"))
    return _whole_tree(leaves)


def _differing(store: RunStore, digests: DataFrame, commit: dict | None) -> tuple[DataFrame, list[int], DataFrame | None]:
    """The leaves at which the tree over the written ``digests`` differs from the saved one, the buckets they lie in, and the saved tree.

    From the root downwards: first its children, whose differing ones, at most 256, tell which leaves are compared at all.
    """
    saved = store.state("tree", commit=commit)
    if saved is None:
        return digests.select("node"), list(range(1 << store.bucket_bits)), None
    now, parent = digests.coalesce(1), F.shiftright("node", FAN_BITS)
    level = lambda k: saved.where(F.col("level") == k).select("node", "digest").coalesce(1)

    def differ(a: DataFrame, b: DataFrame) -> DataFrame:
        both = a.join(b.withColumnRenamed("digest", "saved"), "node", "full_outer")
        return both.where(~F.col("digest").eqNullSafe(F.col("saved"))).select("node")

    children = now.groupBy(parent.alias("node")).agg(_digest(F.col("node"), F.col("digest")).alias("digest"))
    nodes = sorted(r[0] for r in differ(children, level(1)).collect())
    leaves = cut(differ(now.where(parent.isin(nodes)), level(0).where(parent.isin(nodes))))
    return leaves, sorted({n >> (FAN_BITS - store.bucket_bits) for n in nodes}), saved


def run_words(store: RunStore, now: DataFrame, spaces: tuple[str, ...], number: str, process: Callable[[DataFrame], DataFrame] | None, appended: bool = False) -> dict:
    """One run over words. ``process`` gets (spaces, number) of what no earlier run had; its output, the words and the tree are published
    together. Without ``process`` they are only noted as processed.

    ``now`` is read several times: give a written table. It holds all records' words, whose tree is compared with the saved one; or,
    with ``appended``, those of the records that came since, whose leaves are the ones that can differ. In both cases saved words are
    read from, and written to, the buckets of differing leaves only. Numbers that are gone from the records stay processed.
    """
    placed = now.select(*spaces, "word", "bits", _position(spaces).alias("node"))
    commit, draft = store.last(), store.draft()
    digests = None if appended and commit else cut(_word_digests(placed, spaces))
    if digests is None:
        leaves, saved_tree = cut(placed.select("node").distinct()), store.state("tree", commit=commit)
        buckets = sorted(r[0] for r in leaves.select(_bucket(store)).distinct().collect())  # at most 256
    else:
        leaves, buckets, saved_tree = _differing(store, digests, commit)
    saved = store.state("words", buckets, commit)
    mine = placed if commit is None else placed.join(F.broadcast(leaves), "node", "left_semi").select(*placed.columns)
    merged = mine
    if saved is not None:
        saved = saved.select(*placed.columns)
        merged = saved.unionByName(mine).groupBy(*spaces, "word", "node").agg(F.bit_or("bits").alias("bits")).select(*placed.columns)

    def out() -> None:
        if process:
            before = placed.limit(0) if saved is None else saved.join(F.broadcast(leaves), "node", "left_semi")
            draft.keep(process(fresh_numbers(mine.drop("node"), before.drop("node"), spaces, number)), "output")

    def state() -> DataFrame:
        written = draft.keep_buckets(merged.withColumn("bucket", _bucket(store)), "words", buckets)
        return digests if commit is None else cut(_word_digests(written.join(F.broadcast(leaves), "node", "left_semi"), spaces))

    own = side_by_side(state, out)[0]
    return store.publish_parts({}, {"tree": _new_tree(saved_tree, leaves, own)}, draft=draft)


def run_numbered(store: RunStore, records: DataFrame, spaces: tuple[str, ...], number: str, process: Callable[[DataFrame], DataFrame]) -> dict:
    """One run over all numbered records: see :func:`run_words`."""
    return run_words(store, cut(words(records, spaces, number)), spaces, number, process)


def run_appended(store: RunStore, batch: DataFrame, spaces: tuple[str, ...], number: str, process: Callable[[DataFrame], DataFrame]) -> dict:
    """One run over the records that were delivered since the last committed one, older ones among them or not: see :func:`run_words`."""
    return run_words(store, cut(words(batch, spaces, number)), spaces, number, process, appended=True)


def run_keyed(store: RunStore, records: DataFrame, keys: tuple[str, ...], content: tuple[str, ...], process: Callable[[DataFrame, DataFrame], DataFrame]) -> dict:
    """One run over keyed records: ``process`` gets the added and changed records, and (key_hash, change) with the removed keys.

    The records that go out are read once and kept, and the digests that are published for them are computed from what was kept, so a
    record that changes during the run goes out again in the next one. Saved digests are read from differing buckets only.
    """
    commit, draft = store.last(), store.draft()
    now = cut(key_index(records, keys, content, LEAVES_BITS))
    leaves, buckets, saved_tree = _differing(store, cut(index_leaves(now)), commit)
    mine = now.join(F.broadcast(leaves), "node", "left_semi")
    saved = store.state("index", buckets, commit)
    saved = (saved if saved is not None else now.limit(0)).select(*now.columns)
    changes = cut(compare_indexes(mine, saved.join(F.broadcast(leaves), "node", "left_semi")))
    out = changes.where(F.col("change") != "removed").select(F.col("key_hash").alias("__key_hash"))
    fresh = cut(records.withColumn("__key_hash", key_hash(keys)).join(out, "__key_hash", "left_semi").drop("__key_hash"))
    draft.keep(process(fresh, changes), "output")
    index = mine.join(changes, "key_hash", "left_anti").select(*now.columns).unionByName(key_index(fresh, keys, content, LEAVES_BITS))
    others = saved.join(F.broadcast(leaves), "node", "left_anti").select(*now.columns)
    written = draft.keep_buckets(others.unionByName(index).withColumn("bucket", _bucket(store)), "index", buckets)
    own = cut(index_leaves(written.join(F.broadcast(leaves), "node", "left_semi")))
    return store.publish_parts({}, {"tree": _new_tree(saved_tree, leaves, own)}, draft=draft)
