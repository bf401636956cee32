"""The queries p1 and p7 to p9 and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import leakage, mixing, quantiles, repetition
from tidemark.session import broadcast_within, cut, table

Query = Callable[[SparkSession, str], DataFrame]

PROBS = (0.5, 0.9, 0.99)
SKETCH = quantiles.Sketch()
CHECKED = quantiles.Sketch(sparse_limit=8192)  # hot names are sketched from sf0.1 on
SMALL = quantiles.Sketch(sparse_limit=256)  # hundreds of names are sketched


def p1_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Median, p90 and p99 of ``value`` per name over all rows."""
    return quantiles.percentiles(table(spark, d, "stream_table"), ["name"], "value", PROBS, sk=SKETCH).drop("exact")


def _by_day(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "stream_table").withColumn("arrival_day", F.floor(F.col("batch_id") / 24).cast("int"))


def _merged_days(spark: SparkSession, d: str, sk: quantiles.Sketch) -> DataFrame:
    days = quantiles.merge(quantiles.summarise(_by_day(spark, d), ["name", "arrival_day"], "value", sk=sk), ["name", "arrival_day"], sk)
    return quantiles.merge(days.drop("arrival_day"), ["name"], sk, probs=PROBS)


def p1_merged_days(spark: SparkSession, d: str) -> DataFrame:
    """The same from states that are kept per name and day of arrival, then added up."""
    return _merged_days(spark, d, SKETCH).drop("exact")


def _within(rows: DataFrame, got: DataFrame, sk: quantiles.Sketch) -> DataFrame:
    """(name, n, sketched, ok_p50, ...): whether the exact ranks, in ``rows``, of the percentiles ``got`` are within the stated error."""
    rows = rows.select("name", F.col("value").cast("double").alias("value")).where(F.col("value").isNotNull())
    got = broadcast_within(cut(got.withColumnRenamed("name", "key")), 200_000)
    met = rows.join(got, rows["name"].eqNullSafe(got["key"]))
    aggs = [F.max("n").alias("n"), (~F.max("exact")).alias("sketched")]
    for p in PROBS:
        q = F.col(quantiles.column_of(p))
        slack = F.abs(q) * 2.0**-sk.mantissa_bits
        aggs += [F.count(F.when(F.col("value") < q - slack, 1)).alias(f"below_{p}"), F.count(F.when(F.col("value") <= q + slack, 1)).alias(f"upto_{p}")]
    ranks = met.groupBy("name").agg(*aggs)
    error, oks = F.col("n") * sk.rank_error, []
    for p in PROBS:
        target = F.ceil(F.col("n") * p)
        oks.append(((F.col(f"`below_{p}`") - error < target) & (F.col(f"`upto_{p}`") + error >= target)).alias(f"ok_{quantiles.column_of(p)}"))
    return ranks.select("name", "n", "sketched", *oks)


def p1_within_bound(spark: SparkSession, d: str) -> DataFrame:
    """Per name whether the exact ranks of its percentiles are within the stated error, names of more than 8192 codes being sketched."""
    rows = table(spark, d, "stream_table")
    return _within(rows, quantiles.percentiles(rows, ["name"], "value", PROBS, sk=CHECKED), CHECKED).drop("sketched")


def p1_sketched(spark: SparkSession, d: str) -> DataFrame:
    """The same with names of more than 256 codes sketched, and which those are."""
    rows = table(spark, d, "stream_table")
    return _within(rows, quantiles.percentiles(rows, ["name"], "value", PROBS, sk=SMALL), SMALL)


def p1_sketched_days(spark: SparkSession, d: str) -> DataFrame:
    """The same from states per name and day, added up."""
    return _within(table(spark, d, "stream_table"), _merged_days(spark, d, SMALL), SMALL)


def p1_taken_back(spark: SparkSession, d: str) -> DataFrame:
    """All rows are added and those of jobs 1 to 3 taken back again: what is left must be as if they had never come."""
    rows = table(spark, d, "stream_table")
    gone = F.coalesce(F.col("job_id").between(1, 3), F.lit(False))
    signed = rows.select("name", "value", F.lit(1).alias("w")).unionByName(rows.where(gone).select("name", "value", F.lit(-1).alias("w")))
    got = quantiles.percentiles(signed, ["name"], "value", PROBS, "w", SMALL)
    return _within(rows.where(~gone), got.where(F.col("n") > 0), SMALL).drop("sketched")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    found = leakage.matched_windows(table(spark, d, "documents"), table(spark, d, "eval_item"))
    return found.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id")).distinct()


def p7_coverage(spark: SparkSession, d: str) -> DataFrame:
    """How much of an item each page contains, in windows of 13 words."""
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_item")).select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), "windows", "item_windows", "share")


def _mixer(spark: SparkSession, d: str) -> mixing.Mixer:
    return mixing.Mixer(table(spark, d, "documents"), table(spark, d, "mix_target"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _mixer(spark, d).plan().where("short").select("source")


def p8_sizes(spark: SparkSession, d: str) -> DataFrame:
    return _mixer(spark, d).plan().select("source", "available", "short")


def p8_plan(spark: SparkSession, d: str) -> DataFrame:
    return _mixer(spark, d).plan().withColumns({"amount": F.round("amount", 4), "repeats": F.round("repeats", 9)})


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mixer(spark, d).chosen().withColumnRenamed("doc", "doc_id")


def p8_reached(spark: SparkSession, d: str) -> DataFrame:
    return _mixer(spark, d).reached()


def p8_tokens(spark: SparkSession, d: str) -> DataFrame:
    """The plan for sizes in tokens of a public tokenizer, whose file the setting spark.tidemark.tokenizer names."""
    path = spark.conf.get("spark.tidemark.tokenizer", "/opt/tokenizers/byte_bpe_50k.json")
    return mixing.Mixer(table(spark, d, "documents"), table(spark, d, "mix_target"), size=mixing.tokenizer_size(path)).plan()


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return repetition.repetitive(repetition.judge(table(spark, d, "documents"))).select(F.col("doc").alias("doc_id"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return repetition.measure(table(spark, d, "documents")).select(F.col("doc").alias("doc_id"), "n_words", "repeated_words", "distinct_words", "top_phrase")


def p9_quality(spark: SparkSession, d: str) -> DataFrame:
    """Each page's votes, its posterior probability of being repetitive, and the verdict that follows from the posterior alone."""
    judged = repetition.judge(table(spark, d, "documents"))
    votes = [f"vote_{k}" for k in judged.names]
    return judged.documents.select(F.col("doc").alias("doc_id"), *votes, F.round("posterior", 6).alias("posterior"), (F.col("posterior") >= 0.5).alias("repetitive"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        p1_percentiles, p1_merged_days, p1_within_bound, p1_sketched, p1_sketched_days, p1_taken_back, p7_found, p7_coverage,
        p8_found, p8_sizes, p8_plan, p8_mix, p8_reached, p8_tokens, p9_found, p9_shares, p9_quality,
    )
}

_WORDS = r"REGEXP_EXTRACT_ALL(LOWER(text), '[\p{L}\p{N}]+')"
_SPACE = r"\x{09}-\x{0D}\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"

_RANKED = """
ranked AS (SELECT name, value, ROW_NUMBER() OVER (PARTITION BY name ORDER BY value) AS r, COUNT(*) OVER (PARTITION BY name) AS n FROM stream_table WHERE value IS NOT NULL),
coded AS (SELECT name, r, n, CASE WHEN ABS(value) < 2097152 THEN value ELSE SIGN(value) * ((ABS(value) >> (LENGTH(BIN(ABS(value))) - 21)) << (LENGTH(BIN(ABS(value))) - 21)) END AS value FROM ranked)
"""
_PERCENTILES = f"""WITH {_RANKED} SELECT name, n, {', '.join(f"CAST(MAX(CASE WHEN r = CEIL(CAST({p} AS DOUBLE) * n) THEN value END) AS DOUBLE) AS {quantiles.column_of(p)}" for p in PROBS)} FROM coded GROUP BY name, n"""

_LEAKS = f"""
item_words AS (SELECT item_id, {_WORDS} AS w FROM eval_item),
item_windows AS (
  SELECT item_id, s AS start, LEAST(13, LEN(w)) AS size, ARRAY_TO_STRING(w[s + 1 : s + LEAST(13, LEN(w))], ' ') AS gram
  FROM (SELECT item_id, w, UNNEST(RANGE(0, LEN(w) - LEAST(13, LEN(w)) + 1)) AS s FROM item_words WHERE LEN(w) > 0)),
sizes AS (SELECT DISTINCT size FROM item_windows),
doc_words AS (SELECT doc_id, {_WORDS} AS w FROM documents),
doc_windows AS (
  SELECT DISTINCT doc_id, size, ARRAY_TO_STRING(w[s + 1 : s + size], ' ') AS gram
  FROM (SELECT doc_id, w, size, UNNEST(RANGE(0, LEN(w) - size + 1)) AS s FROM doc_words, sizes WHERE LEN(w) >= size)),
pairs AS (SELECT d.doc_id, i.item_id, COUNT(*) AS windows FROM doc_windows d JOIN item_windows i ON d.size = i.size AND d.gram = i.gram GROUP BY ALL)
"""

_SIZES = rf"""
sized AS (SELECT LOWER(REGEXP_REPLACE(source, '^[{_SPACE}]+|[{_SPACE}]+$', '', 'g')) AS source, LEN(REGEXP_EXTRACT_ALL(COALESCE(text, ''), '[\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}{_SPACE}]')) AS size FROM documents),
got AS (SELECT m.source, m.target_share, m.max_repeats, CAST(COALESCE(SUM(size), 0) AS BIGINT) AS available FROM mix_target m LEFT JOIN sized s ON m.source = s.source GROUP BY ALL),
judged AS (SELECT source, available, target_share * (SELECT SUM(available) FROM got) > max_repeats * available AS short FROM got)
"""

_RUNS = f"""
doc_words AS (SELECT doc_id, {_WORDS} AS w FROM documents),
runs AS (
  SELECT doc_id, s, ROW_NUMBER() OVER (PARTITION BY doc_id, ARRAY_TO_STRING(w[s + 1 : s + 8], ' ') ORDER BY s) AS nth
  FROM (SELECT doc_id, w, UNNEST(RANGE(0, LEN(w) - 7)) AS s FROM doc_words WHERE LEN(w) >= 8)),
covered AS (SELECT doc_id, COUNT(DISTINCT p) AS repeated FROM (SELECT doc_id, UNNEST(RANGE(s, s + 8)) AS p FROM runs WHERE nth > 1) GROUP BY doc_id),
trios AS (SELECT doc_id, MAX(k) AS top FROM (
  SELECT doc_id, COUNT(*) AS k FROM (SELECT doc_id, ARRAY_TO_STRING(w[s + 1 : s + 3], ' ') AS t FROM (SELECT doc_id, w, UNNEST(RANGE(0, LEN(w) - 2)) AS s FROM doc_words WHERE LEN(w) >= 3)) GROUP BY doc_id, t) GROUP BY doc_id),
shares AS (
  SELECT d.doc_id, COALESCE(LEN(w), 0) AS n_words, COALESCE(repeated, 0) AS repeated_words, COALESCE(LEN(LIST_DISTINCT(w)), 0) AS distinct_words, COALESCE(top, 0) AS top_phrase
  FROM doc_words d LEFT JOIN covered c ON d.doc_id = c.doc_id LEFT JOIN trios t ON d.doc_id = t.doc_id)
"""

_SHORT_CODE = "CASE WHEN ABS(value) < 2097152 THEN value ELSE SIGN(value) * ((ABS(value) >> (LENGTH(BIN(ABS(value))) - 21)) << (LENGTH(BIN(ABS(value))) - 21)) END"
_SKETCHED = f"SELECT name, COUNT(value) AS n, COUNT(DISTINCT {_SHORT_CODE}) > 256 AS sketched, TRUE AS ok_p50, TRUE AS ok_p90, TRUE AS ok_p99 FROM stream_table WHERE value IS NOT NULL GROUP BY name"

# one round of clamping per target is always enough
_CLAMPS = 11
_FILL = f"""{_SIZES},
r0 AS (SELECT source, target_share AS w, max_repeats, available, CAST(max_repeats * available AS DOUBLE) AS cap, FALSE AS clamped, (SELECT CAST(SUM(available) AS DOUBLE) FROM got) AS total FROM got),
{', '.join(f"""r{k + 1} AS MATERIALIZED (
  SELECT * EXCLUDE (clamped), clamped OR w * (SELECT GREATEST(0, MAX(total) - COALESCE(FSUM(cap) FILTER (clamped), 0)) / FSUM(w) FILTER (NOT clamped) FROM r{k}) > cap AS clamped FROM r{k})""" for k in range(_CLAMPS))},
filled AS (
  SELECT source, w, max_repeats, available, w * total > cap AS short,
    CASE WHEN clamped THEN cap ELSE w * (SELECT GREATEST(0, MAX(total) - COALESCE(FSUM(cap) FILTER (clamped), 0)) / FSUM(w) FILTER (NOT clamped) FROM r{_CLAMPS}) END AS amount FROM r{_CLAMPS}),
planned AS (SELECT *, CASE WHEN available > 0 THEN amount / available ELSE 0 END AS repeats FROM filled)
"""

# the same even number of each page, from the first 13 hexadecimal digits of an MD5, and the same steps of 1 / 1024
_CHOSEN = rf"""{_FILL},
pages AS (
  SELECT doc_id, LOWER(REGEXP_REPLACE(source, '^[{_SPACE}]+|[{_SPACE}]+$', '', 'g')) AS source, LEN(REGEXP_EXTRACT_ALL(COALESCE(text, ''), '[\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}{_SPACE}]')) AS size,
    CAST('0x' || MD5('7:' || doc_id)[1:13] AS BIGINT) / 4503599627370496.0 AS u FROM documents),
parts AS (SELECT *, CAST(LEAST(max_repeats, FLOOR(repeats)) AS INTEGER) AS whole FROM planned),
wanted AS (SELECT *, CASE WHEN amount - whole * available > 0 AND whole < max_repeats THEN amount - whole * available ELSE 0 END AS rest FROM parts),
steps AS (SELECT source, CAST(FLOOR(u * 1024) AS INTEGER) AS step, SUM(size) AS n FROM pages WHERE source IS NOT NULL GROUP BY ALL HAVING SUM(size) > 0),
runs AS (SELECT *, SUM(n) OVER (PARTITION BY source ORDER BY step) AS upto FROM steps),
reach AS (SELECT r.source, MIN_BY((step + (rest - (upto - n)) / n) / 1024, step) AS inside FROM runs r JOIN wanted w ON r.source = w.source WHERE rest > 0 AND upto >= rest GROUP BY r.source),
bounds AS (SELECT w.*, CASE WHEN rest > 0 THEN COALESCE(inside, 1.0) ELSE 0.0 END AS below FROM wanted w LEFT JOIN reach r ON w.source = r.source),
taken AS (SELECT p.doc_id, p.source, p.size, whole + CASE WHEN u < below THEN 1 ELSE 0 END AS n FROM pages p JOIN bounds b ON p.source = b.source),
chosen AS (SELECT doc_id, source, CAST(UNNEST(RANGE(1, n + 1)) AS INTEGER) AS copy, size FROM taken WHERE n > 0)
"""

_RULES = ("runs", "lines", "sentences", "paragraphs", "vocabulary", "phrase")


def _pieces_sql(name: str, pattern: str) -> str:
    return rf"""{name}_parts AS (
  SELECT doc_id, piece, LENGTH(piece) AS size, ROW_NUMBER() OVER (PARTITION BY doc_id, piece) AS nth
  FROM (SELECT doc_id, REGEXP_REPLACE(UNNEST(STRING_SPLIT_REGEX(LOWER(COALESCE(text, '')), '{pattern}')), '^[{_SPACE}]+|[{_SPACE}]+$', '', 'g') AS piece FROM documents) WHERE piece <> ''),
{name} AS (SELECT doc_id, COUNT(*) AS n, COALESCE(SUM(size) FILTER (nth > 1), 0) / SUM(size) AS share FROM {name}_parts GROUP BY doc_id)"""


def _vote_sql(share: str, bad: float, good: float, enough: str) -> str:
    return f"CASE WHEN NOT ({enough}) THEN 0 WHEN {share} >= CAST({bad} AS DOUBLE) THEN 1 WHEN {share} <= CAST({good} AS DOUBLE) THEN -1 ELSE 0 END"


def _quality_sql() -> str:
    """The rules' votes, the counts of their patterns, and as many rounds of EM as the operator does, one after another."""
    votes = {
        "runs": "CASE WHEN n_words < 8 THEN 0 WHEN repeated_words * 10 >= n_words * 3 THEN 1 WHEN repeated_words * 20 <= n_words THEN -1 ELSE 0 END",
        "lines": _vote_sql("COALESCE(l.share, 0)", 0.3, 0.02, "COALESCE(l.n, 0) >= 3"),
        "sentences": _vote_sql("COALESCE(e.share, 0)", 0.3, 0.05, "COALESCE(e.n, 0) >= 4"),
        "paragraphs": _vote_sql("COALESCE(g.share, 0)", 0.3, 0.0, "COALESCE(g.n, 0) >= 3"),
        "vocabulary": "CASE WHEN n_words < 50 THEN 0 WHEN distinct_words * 4 < n_words THEN 1 WHEN distinct_words * 2 > n_words THEN -1 ELSE 0 END",
        "phrase": "CASE WHEN n_words < 30 THEN 0 WHEN top_phrase * 30 >= n_words THEN 1 WHEN top_phrase * 90 <= n_words THEN -1 ELSE 0 END",
    }
    cols = [f"vote_{k}" for k in _RULES]
    sign = " + ".join(cols)
    out = [
        _RUNS, _pieces_sql("line", r"\n+"), _pieces_sql("sentence", r"[.!?;]\s+|\n+"), _pieces_sql("para", r"\n\s*\n"),
        f"voted AS MATERIALIZED (SELECT s.doc_id, {', '.join(f'{v} AS vote_{k}' for k, v in votes.items())} FROM shares s LEFT JOIN line l ON s.doc_id = l.doc_id LEFT JOIN sentence e ON s.doc_id = e.doc_id LEFT JOIN para g ON s.doc_id = g.doc_id)",
        f"q0 AS MATERIALIZED (SELECT {', '.join(cols)}, CAST(COUNT(*) AS DOUBLE) AS c, CAST(0.5 AS DOUBLE) + CAST(0.4 AS DOUBLE) * SIGN(SUM({sign})) AS q FROM voted GROUP BY {', '.join(cols)})",
    ]
    for k in range(repetition.ROUNDS):
        rates = []
        for v in cols:
            rates.append(f"(COALESCE(SUM(c * q) FILTER ({v} = 1), 0) + 4) / (COALESCE(SUM(c * q) FILTER ({v} <> 0), 0) + 5) AS sens_{v}")
            rates.append(f"(COALESCE(SUM(c * (1 - q)) FILTER ({v} = -1), 0) + 4) / (COALESCE(SUM(c * (1 - q)) FILTER ({v} <> 0), 0) + 5) AS spec_{v}")
        out.append(f"m{k} AS MATERIALIZED (SELECT (SUM(c * q) + 1) / (SUM(c) + 2) AS prior, {', '.join(rates)} FROM q{k})")
        bad = " + ".join(["LN(prior)", *(f"CASE {v} WHEN 1 THEN LN(sens_{v}) WHEN -1 THEN LN(1 - sens_{v}) ELSE 0 END" for v in cols)])
        good = " + ".join(["LN(1 - prior)", *(f"CASE {v} WHEN -1 THEN LN(spec_{v}) WHEN 1 THEN LN(1 - spec_{v}) ELSE 0 END" for v in cols)])
        out.append(f"q{k + 1} AS MATERIALIZED (SELECT {', '.join(cols)}, c, 1 / (1 + EXP(GREATEST(-700, LEAST(700, ({good}) - ({bad}))))) AS q FROM q{k}, m{k})")
    on = " AND ".join(f"v.{c} = q.{c}" for c in cols)
    return f"WITH {', '.join(out)} SELECT v.doc_id, {', '.join(f'v.{c}' for c in cols)}, ROUND(q, 6) AS posterior, q >= 0.5 AS repetitive FROM voted v JOIN q{repetition.ROUNDS} q ON {on}"


#: Without SQL, and tested against the tokenizer itself instead: p8_tokens.
SQL: dict[str, str] = {
    # exact at the sizes at which SQL is compared: no name there has more distinct values than a state keeps as they are
    "p1_percentiles": _PERCENTILES,
    "p1_merged_days": _PERCENTILES,
    "p1_within_bound": "SELECT name, COUNT(value) AS n, TRUE AS ok_p50, TRUE AS ok_p90, TRUE AS ok_p99 FROM stream_table WHERE value IS NOT NULL GROUP BY name",
    "p1_sketched": _SKETCHED,
    "p1_sketched_days": _SKETCHED,
    "p1_taken_back": "SELECT name, COUNT(value) AS n, TRUE AS ok_p50, TRUE AS ok_p90, TRUE AS ok_p99 FROM stream_table WHERE value IS NOT NULL AND NOT COALESCE(job_id BETWEEN 1 AND 3, FALSE) GROUP BY name",
    "p7_found": f"WITH {_LEAKS} SELECT doc_id, item_id FROM pairs",
    "p7_coverage": f"""WITH {_LEAKS}, per_item AS (SELECT item_id, COUNT(*) AS item_windows FROM item_windows GROUP BY item_id)
        SELECT p.doc_id, p.item_id, windows, item_windows, windows / item_windows AS share FROM pairs p JOIN per_item i ON p.item_id = i.item_id""",
    "p8_found": f"WITH {_SIZES} SELECT source FROM judged WHERE short",
    "p8_sizes": f"WITH {_SIZES} SELECT source, available, short FROM judged",
    "p8_plan": f"WITH {_FILL} SELECT source, w AS target_share, max_repeats, available, ROUND(amount, 4) AS amount, ROUND(repeats, 9) AS repeats, short FROM planned",
    "p8_mix": f"WITH {_CHOSEN} SELECT * FROM chosen",
    "p8_reached": f"""WITH {_CHOSEN}, per AS (SELECT source, COUNT(*) AS copies, CAST(SUM(size) AS BIGINT) AS size FROM chosen GROUP BY source)
        SELECT w.source, w AS target_share, COALESCE(copies, 0) AS copies, COALESCE(size, 0) AS size, COALESCE(size, 0) / CAST((SELECT SUM(size) FROM per) AS DOUBLE) AS share FROM wanted w LEFT JOIN per p ON w.source = p.source""",
    "p9_quality": _quality_sql(),
    "p9_found": f"WITH {_RUNS} SELECT doc_id FROM shares WHERE n_words > 0 AND repeated_words * 10 >= n_words * 3",
    "p9_shares": f"WITH {_RUNS} SELECT * FROM shares",
}
