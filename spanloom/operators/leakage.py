"""Leakage guard: fingerprints of a private corpus and matches in candidate texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import let
from ..functions.vectors import word_ngrams
from ..session import checkpoint_dir
from .ranking import top_k

# Words too common to count as a trace of the corpus.
COMMON_WORDS = [
    "about", "after", "also", "annotation", "answer", "before", "candidate", "concept", "description", "example", "examples", "format", "from", "gold", "label", "labels", "mark",
    "model", "output", "prompt", "rule", "rules", "span", "spans", "task", "term", "terms", "text", "that", "this", "with",
]
# Sources whose traces are critical, and statuses of blocked candidates.
CRITICAL_SOURCES = ["gold_span", "runtime_annotation", "model_span"]
BLOCKED_STATUSES = ["memorization_guard_blocked", "memorization_repair_failed"]
BITS = 1 << 24


def leak_units(text: Column) -> Column:
    """Distinct units of a text: words of four letters or more without common ones, their 2- and 3-grams, CJK 2- and 3-grams."""
    low = F.lower(F.coalesce(text, F.lit("")))
    found = F.filter(F.regexp_extract_all(low, F.lit("[a-z][a-z0-9-]*"), F.lit(0)), lambda w: (F.length(w) >= 4) & ~w.isin(COMMON_WORDS))

    def cjk(run: Column, n: int) -> Column:
        idx = F.when(F.length(run) >= n, F.sequence(F.lit(1), F.length(run) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(idx, lambda i: F.substring(run, i, F.lit(n)))

    runs = F.regexp_extract_all(low, F.lit("[一-鿿]+"), F.lit(0))
    grams = F.flatten(F.transform(runs, lambda r: F.concat(cjk(r, 2), cjk(r, 3))))
    units = let(found, lambda w: F.concat(w, word_ngrams(w, 2), word_ngrams(w, 3), grams))
    return F.array_distinct(F.filter(units, lambda u: (u != "") & ~u.isin(COMMON_WORDS)))


def unit_hash(unit: Column) -> Column:
    return F.substring(F.sha2(unit, 256), 1, 16)


def fingerprint(corpus: DataFrame, allowed: list[str] = ()) -> DataFrame:
    """(hash, unit_count, critical, blocked) over (source_id, text, source_type); units of allowed terms do not block."""
    critical = F.col("source_type").isin(CRITICAL_SOURCES)
    rows = corpus.select(critical.alias("c"), F.explode(leak_units(F.col("text"))).alias("unit"))
    fp = rows.groupBy(unit_hash(F.col("unit")).alias("hash")).agg(F.count(F.lit(1)).alias("occurrences"), F.max("c").alias("critical"), F.min("unit").alias("unit"))
    ok = F.array_contains(leak_units(F.lit(" ".join(allowed))), F.col("unit")) if allowed else F.lit(False)
    return fp.withColumn("blocked", ~ok)


def fingerprint_summary(fp: DataFrame) -> DataFrame:
    return fp.agg(F.count(F.lit(1)).alias("token_count"), F.count_if("blocked").alias("blocked_hash_count"), F.count_if(F.col("blocked") & F.col("critical")).alias("critical_count"))


def possible_units(texts: DataFrame, blocked: DataFrame, key: str = "id") -> DataFrame:
    """(key, hash) of those units of each text whose hash may be among the blocked ones: all that are, and few others.

    The bit map is a filter of ``BITS`` bits whatever the size of the fingerprint, at most BITS / 64 rows of two numbers.
    """
    checkpoint_dir(texts.sparkSession)
    bit = F.pmod(F.xxhash64("hash"), F.lit(BITS))
    cells = blocked.select(bit.alias("h_")).groupBy(F.shiftright("h_", 6).alias("cell_")).agg(F.bit_or(F.expr("1L << CAST(h_ & 63 AS INT)")).alias("bits_"))
    units = texts.select(key, F.explode(leak_units(F.col("text"))).alias("unit")).select(key, unit_hash(F.col("unit")).alias("hash")).withColumn("h_", bit)
    near = units.join(F.broadcast(cells), F.shiftright("h_", 6) == F.col("cell_"))
    return near.where(F.expr("(bits_ >> CAST(h_ & 63 AS INT)) & 1L = 1L")).select(key, "hash")


def leak_check(texts: DataFrame, fp: DataFrame, key: str = "id", shown: int = 20) -> DataFrame:
    """Matches of each text with the blocked fingerprint: count, first hashes, severity.

    Units that no blocked hash can have are held back by a bit map before the join. A text contributes each unit once and a hash has one
    fingerprint row, so the join adds no rows; a unit found in a large share of all texts is only a hot key on the text side, which
    adaptive execution splits. Of the hashes of a text only the first ``shown`` are ever brought together.
    """
    blocked = fp.where("blocked").select("hash", "critical")
    hits = possible_units(texts, blocked, key).join(blocked, "hash").checkpoint()
    counts = hits.groupBy(key).agg(F.count(F.lit(1)).alias("match_count"), F.max("critical").alias("critical"))
    some = top_k(hits.select(key, "hash"), [key], ["hash"], shown).groupBy(key).agg(F.array_sort(F.collect_list("hash")).alias("matched_hashes"))
    out = texts.select(key).join(counts.join(some, key), key, "left")
    n = F.coalesce("match_count", F.lit(0))
    return out.select(
        key, n.alias("match_count"), (n == 0).alias("passed"), F.when(n == 0, "clean").when(F.col("critical"), "critical_leak").otherwise("soft_leak").alias("severity"),
        F.coalesce("matched_hashes", F.array().cast("array<string>")).alias("matched_hashes"),
    )


def leakage_report(candidates: DataFrame, final_check: DataFrame | None = None) -> DataFrame:
    """One row: blocked candidates, repair counts and whether the final text is clean."""
    from .stats import one_row, repair_summary

    a = repair_summary(candidates)
    b = candidates.agg(F.count_if(F.col("status").isin(BLOCKED_STATUSES)).alias("candidate_blocked_count"))
    c = candidates.sparkSession.range(1).select(F.lit(True).alias("final_prompt_clean")) if final_check is None else final_check.agg(F.coalesce(F.min("passed"), F.lit(True)).alias("final_prompt_clean"))
    return one_row(a, b, c)
