"""Quality rules whose limits follow each language and source instead of fixed cutoffs.

Every document gets a few whole-number measures. Their distributions over the documents that pass the base rules are kept as mergeable
quantile sketches: counts of rounded-down values, where a value keeps its seven leading bits, so a bucket is under 1/64 wide and
two sketches merge by adding counts. A limit of a (language, source) group lies beyond the upper tail of the group's own sketch, by a
multiple of the spread of the values above zero: most rates are zero for most documents, and what the others have says how far apart
values usually are. A group of few documents takes the merged sketch of its language, a rare language that of all documents, and
so it goes for the spread where few values are above zero. Only where those fall into fewer than ``KINDS`` buckets a constant stands for the
spread; ``bounded`` tells in how many groups.

Everything is DataFrame expressions or SQL; a text is read in place and never shuffled. NULL text has no words. NULL language or
source is a group of its own. Repeated rows are judged alike. Other columns of the input are ignored or kept as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.core import let
from .shared import stored

BLANK = r"\x20\x09-\x0D"
SYMBOLS = "#*$%&|<>"
MIN_DOCS = 100
KINDS = 4
# Measure: (quantile of the group's sketch in percent from which a limit is reckoned, spreads beyond it, spread where values are too few, limit below).
RULES = {"symbol_rate": (95, 1, 32, False), "dup_line_rate": (95, 3, 110, False), "repeat_rate": (95, 4, 80, False), "word_length": (75, 8, 20, True)}


def _repeated(hashes: Column) -> Column:
    """How many words lie in windows of three that occur twice or more, from the hashes of all windows."""

    def places(sorted_: Column) -> Column:
        same = lambda s, k: (F.get(sorted_, k - 1)["h"] == s["h"]) | (F.get(sorted_, k + 1)["h"] == s["h"])
        return F.sort_array(F.transform(F.filter(sorted_, lambda s, k: F.coalesce(same(s, k), F.lit(False))), lambda s: s["i"]))

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda i, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - i, F.lit(3))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    windows = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), let(let(windows, places), covered)).otherwise(F.lit(0))


def measure(docs: DataFrame, *also: str) -> DataFrame:
    """doc_id, lang, source (and other columns asked for) with the measures of every document, in one pass without a shuffle."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", "lang", "source", *also, text.alias("text_"))
    rows = rows.withColumn("words_", F.expr(f"regexp_extract_all(text_, '[^{BLANK}]+', 0)".replace("\\", "\\\\")))
    rows = rows.withColumn("word_hash_", F.transform("words_", lambda w: F.xxhash64(w)))
    at = lambda i: F.get(F.col("word_hash_"), i)
    n = F.size("words_")
    window_hashes = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(at(i), at(i + 1), at(i + 2)))).otherwise(F.array().cast("array<bigint>"))
    lines = F.filter(F.split("text_", "\n"), lambda x: x.rlike(f"[^{BLANK}]"))
    rows = rows.withColumn("windows_", window_hashes).withColumn("lines_", lines)
    # A generator, not a projection: a filter on the measures must not be moved below, where it would compute them once per word.
    return rows.select("doc_id", "lang", "source", *also, F.inline(F.array(_measures(n))))


def _measures(n: Column) -> Column:
    counted = F.struct(
        n.cast("long").alias("n_words"),
        F.char_length(F.regexp_replace("text_", f"[{BLANK}]+", "")).cast("long").alias("word_chars"),
        F.char_length(F.regexp_replace("text_", f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
        F.size("lines_").cast("long").alias("n_lines"),
        (F.size("lines_") - F.size(F.array_distinct("lines_"))).cast("long").alias("n_dup_lines"),
        _repeated(F.col("windows_")).cast("long").alias("n_repeat_words"),
    )
    share = lambda times, part, whole: F.call_function("div", times * part, F.greatest(whole, F.lit(1)))
    return let(counted, lambda c: F.struct(
        *[c[name].alias(name) for name in ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")],
        share(1000, c["n_symbols"], c["word_chars"]).alias("symbol_rate"),
        share(1000, c["n_dup_lines"], c["n_lines"]).alias("dup_line_rate"),
        share(1000, c["n_repeat_words"], c["n_words"]).alias("repeat_rate"),
        share(100, c["word_chars"], c["n_words"]).alias("word_length"),
        ((c["n_words"] < 50) | (100 * c["n_repeat_words"] > 50 * c["n_words"])).alias("base_failed"),
    ))


# The statements below run on Spark and, as they stand, on DuckDB.
_SKETCH = """
SELECT lang, source, rule, (v >> d) << d AS bucket, count(*) AS n
FROM (SELECT lang, source, rule, v, CAST(greatest(length(bin(v)) - 7, 0) AS INT) AS d FROM {values})
GROUP BY lang, source, rule, (v >> d) << d
"""
_LIMITS = """
WITH merged AS (
  SELECT 3 AS lvl, lang, source, rule, bucket, n FROM {sketch}
  UNION ALL SELECT 2, lang, NULL, rule, bucket, sum(n) FROM {sketch} GROUP BY lang, rule, bucket
  UNION ALL SELECT 1, NULL, NULL, rule, bucket, sum(n) FROM {sketch} GROUP BY rule, bucket
), ranked AS (
  SELECT *, sum(n) OVER (PARTITION BY lvl, lang, source, rule ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY lvl, lang, source, rule) AS total,
         sum(CASE WHEN bucket > 0 THEN n ELSE 0 END) OVER (PARTITION BY lvl, lang, source, rule ORDER BY bucket) AS upto_p,
         sum(CASE WHEN bucket > 0 THEN n ELSE 0 END) OVER (PARTITION BY lvl, lang, source, rule) AS total_p
  FROM merged
), quantiles AS (
  SELECT lvl, lang, source, rule, max(total) AS total, min(CASE WHEN 4 * upto >= total THEN bucket END) AS low, min(CASE WHEN 100 * upto >= {tail} * total THEN bucket END) AS high,
         max(total_p) AS total_p, sum(CASE WHEN bucket > 0 THEN 1 ELSE 0 END) AS kinds,
         coalesce(min(CASE WHEN bucket > 0 AND 4 * upto_p >= 3 * total_p THEN bucket END) - min(CASE WHEN bucket > 0 AND 4 * upto_p >= total_p THEN bucket END), 0) AS spread
  FROM ranked GROUP BY lvl, lang, source, rule
), chosen AS (
  SELECT g.lang, g.source, g.rule,
         CASE WHEN g.total >= {min_docs} THEN g.low WHEN l.total >= {min_docs} THEN l.low ELSE a.low END AS low,
         CASE WHEN g.total >= {min_docs} THEN g.high WHEN l.total >= {min_docs} THEN l.high ELSE a.high END AS high,
         CASE WHEN g.total_p >= {min_docs} THEN g.kinds WHEN l.total_p >= {min_docs} THEN l.kinds ELSE a.kinds END AS kinds,
         CASE WHEN g.total_p >= {min_docs} THEN g.spread WHEN l.total_p >= {min_docs} THEN l.spread ELSE a.spread END AS spread
  FROM quantiles g
  JOIN quantiles l ON l.lvl = 2 AND l.rule = g.rule AND l.lang IS NOT DISTINCT FROM g.lang
  JOIN quantiles a ON a.lvl = 1 AND a.rule = g.rule
  WHERE g.lvl = 3
), reckoned AS (SELECT lang, source, rule, low, high, CASE WHEN kinds >= {kinds} AND spread > 0 THEN spread ELSE {least} END AS spread, kinds < {kinds} OR spread = 0 AS bounded FROM chosen)
SELECT lang, source, {fences} FROM reckoned GROUP BY lang, source
"""


def _by_rule(place: int) -> str:
    return "CASE rule " + " ".join(f"WHEN '{name}' THEN {r[place]}" for name, r in RULES.items()) + " END"


def _fences() -> str:
    out = ["CAST(sum(CASE WHEN bounded THEN 1 ELSE 0 END) AS BIGINT) AS bounded_rules"]
    for name, (_, reach, _, low) in RULES.items():
        if low:
            out.append(f"CAST(max(CASE WHEN rule = '{name}' THEN low - {reach} * spread END) AS BIGINT) AS {name}_min")
        out.append(f"CAST(max(CASE WHEN rule = '{name}' THEN high + {reach} * spread END) AS BIGINT) AS {name}_max")
    return ", ".join(out)


def _limits(sketch: str, min_docs: int) -> str:
    parts = {"{sketch}": sketch, "{fences}": _fences(), "{min_docs}": str(int(min_docs)), "{tail}": _by_rule(0), "{least}": _by_rule(2), "{kinds}": str(KINDS)}
    text = _LIMITS
    for mark, part in parts.items():
        text = text.replace(mark, part)
    return text


def _failed() -> str:
    tests = [f"m.{name} < t.{name}_min" for name, r in RULES.items() if r[3]] + [f"m.{name} > t.{name}_max" for name in RULES]
    return " OR ".join(tests)


def sketch(measures: DataFrame) -> DataFrame:
    """Bucket counts of each measure per language and source, over the documents that pass the base rules."""
    pairs = F.array(*[F.struct(F.lit(name).alias("rule"), F.col(name).alias("v")) for name in RULES])
    values = measures.where("NOT base_failed").select("lang", "source", F.explode(pairs).alias("p")).select("lang", "source", "p.rule", "p.v")
    return measures.sparkSession.sql(_SKETCH, values=values)


def limits(sketches: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """The limits of each (language, source) group: at most one row per group."""
    return sketches.sparkSession.sql(_limits("{sketch}", min_docs), sketch=sketches)


def bounded(table: DataFrame) -> DataFrame:
    """How many groups have limits, and for how many of their rules a constant stands for the spread."""
    return table.agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum("bounded_rules"), F.lit(0)).alias("bounded_rules"))


def judge(measures: DataFrame, table: DataFrame) -> DataFrame:
    """Measures with ``kept``. The few limits are joined on group equality; the planner broadcasts them if their stored size allows."""
    m, t = measures.alias("m"), table.alias("t")
    joined = m.join(t, F.expr("m.lang <=> t.lang AND m.source <=> t.source"), "left")
    return joined.select("m.*", F.expr(f"NOT m.base_failed AND NOT coalesce({_failed()}, false)").alias("kept"))


def rated(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """One row per input row: measures, ``base_failed`` and ``kept``. The measures are stored once and used for limits and verdicts."""
    measures = stored(measure(docs))
    return judge(measures, stored(limits(stored(sketch(measures)), min_docs)))


def keep_good(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """The input rows that pass, with the columns they came with.

    Measured twice, once for the limits and once for the verdict, so that no text is shuffled or stored.
    """
    table = stored(limits(stored(sketch(measure(docs))), min_docs))
    whole = docs.select("doc_id", "lang", "source", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row_"))
    passed = judge(measure(whole, "row_"), table).where("kept")
    return passed.select("row_.*")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document."""
    return rated(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


MEASURES_SQL = r"""
texts AS (SELECT doc_id, lang, source, coalesce(text, '') AS text FROM {docs}),
words AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM texts),
windows AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: [w[i], w[i + 1], w[i + 2]])) AS x, unnest(range(1, len(w) - 1)) AS i FROM words WHERE len(w) >= 3),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS n FROM windows) WHERE n > 1),
repeats AS (SELECT doc_id, CAST(sum(least(3, coalesce(nxt - i, 3))) AS BIGINT) AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM twice) GROUP BY doc_id),
lines AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM texts),
counts AS (
  SELECT t.doc_id, t.lang, t.source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         coalesce(r.n, 0) AS n_repeat_words
  FROM texts t JOIN words USING (doc_id) JOIN lines USING (doc_id) LEFT JOIN repeats r USING (doc_id)),
measures AS (
  SELECT *, 1000 * n_symbols // greatest(word_chars, 1) AS symbol_rate, 1000 * n_dup_lines // greatest(n_lines, 1) AS dup_line_rate,
         1000 * n_repeat_words // greatest(n_words, 1) AS repeat_rate, 100 * word_chars // greatest(n_words, 1) AS word_length,
         n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed
  FROM counts)
""".replace("\\\\", "\\")


def judged_sql(docs: str = "documents") -> str:
    """DuckDB statement for the rows of ``rated`` over a table."""
    values = " UNION ALL ".join(f"SELECT lang, source, '{name}' AS rule, {name} AS v FROM measures WHERE NOT base_failed" for name in RULES)
    table = _limits(f"({_SKETCH.format(values=f'({values})')})", MIN_DOCS)
    return (
        f"WITH {MEASURES_SQL.replace('{docs}', docs)}, limits AS ({table}) SELECT m.*, NOT m.base_failed AND NOT coalesce({_failed()}, false) AS kept "
        "FROM measures m LEFT JOIN limits t ON m.lang IS NOT DISTINCT FROM t.lang AND m.source IS NOT DISTINCT FROM t.source"
    )


QUERIES = {"op1_quality_rules": op1_quality_rules}
STATEMENTS = {
    "op1_quality_rules": f"SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM ({judged_sql()})",
}
