"""Near duplicates by Jaccard similarity of word shingles, decided in order: an item goes when an accepted earlier one is as similar as the limit.

Most texts have no similar one, and a part of their shingles tells so. Two sets that reach the limit share shingles among the smallest
hashes of both, the more the longer that part is taken: with l more than needed for one, at least l. Texts that share fewer of their
part with others are accepted, and only the sets of the rest are kept and counted.

Two sets of sizes m and s that reach the limit t share a shingle among the first m - t m + 1 and s - t s + 1 of their rarest; only
those stand in lists, without the ones that no other set has. Sizes and the places of the common shingle rule out most of what still
meets, and sets are compared in full only then.

Items are decided in waves. An item that no earlier item precedes in any of its lists has no earlier neighbour at all and is accepted.
The accepted items of a wave, and only they, are compared with the undecided ones in their lists, which rejects what is similar. So n
near copies of one text give n rows, not n squared: the first is accepted, and meets each of the others once. Lists whose members
share a rare shingle and little else advance by one task a wave; what is left after ``WAVES`` waves is compared within its lists, and the
same rule is followed along the pairs that are similar.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import let
from ..functions.text import words
from ..session import checkpoint_dir, kept

LIMIT = 0.8
WORDS = 5
WAVES = 6
SHARE = 0.1


def shingles(text: Column, n: int = WORDS) -> Column:
    """Hashes of the distinct runs of n words; a text of fewer words is one run, a text without words has none. NULL has no words."""

    def runs(w: Column) -> Column:
        places = F.when(F.size(w) == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), F.greatest(F.size(w) - n, F.lit(0))))
        # Words hold no blanks, so the joined run tells them apart.
        return F.array_distinct(F.transform(places, lambda i: F.xxhash64(F.array_join(F.slice(w, i + 1, n), " "))))

    return let(words(F.coalesce(text, F.lit(""))), runs)


def least(size: Column, limit: float) -> Column:
    """Shingles that a set shares at least with one that reaches the limit, which is also the least size of that one."""
    return F.ceil(limit * size - F.lit(1e-9)).cast("int")


def promising(items: DataFrame, limit: float, n: int) -> DataFrame:
    """Distinct ids of the texts that may be similar to another; no other text is."""
    more = lambda size: F.greatest(F.lit(1), F.floor(min(SHARE, limit) * size).cast("int"))
    size = F.col("size")
    sets = items.select("id", F.sort_array(shingles(F.col("text"), n)).alias("h")).select("id", F.size("h").alias("size"), "h")
    # The first more(size) common shingles are among these of either set, so the smaller set says how many are in both.
    each = sets.select("id", "size", F.explode(F.slice("h", 1, size - least(size, limit) + more(size))).alias("token"))
    token = Window.partitionBy("token")
    met = each.withColumn("met", F.min("id").over(token) != F.max("id").over(token)).where("met")
    return met.groupBy("id", "size").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= more(least(size, limit))).select("id").distinct()


def prefixes(sets: DataFrame, limit: float) -> DataFrame:
    """(id, task, at, size, place, token) of the rarest shingles of every set, as many as similar sets must share one of, without those that one set has alone."""
    each = sets.select("id", F.explode("h").alias("token"))
    shared = each.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("token"))).where("n > 1")
    ordered = shared.groupBy("id").agg(F.array_sort(F.collect_set(F.struct("n", "token"))).alias("t"))
    alone = F.col("size") - F.size("t")  # they come first
    length = F.col("size") - least(F.col("size"), limit) + 1 - F.col("alone")
    some = ordered.join(sets.select("id", "task", "at", F.size("h").alias("size")), "id").select("*", alone.alias("alone")).select("*", length.alias("length")).where("length > 0")
    rows = some.select("id", "task", "at", "size", "alone", F.posexplode(F.slice("t", 1, F.col("length"))).alias("place", "s"))
    return rows.select("id", "task", "at", "size", (F.col("place") + F.col("alone")).alias("place"), F.col("s.token").alias("token"))


def similar(candidates: DataFrame, sets: DataFrame, limit: float) -> DataFrame:
    """(id, other, similarity) of those candidates (id, other) that reach the limit."""
    a = sets.select("id", F.col("h").alias("a_"))
    b = sets.select(F.col("id").alias("other"), F.col("h").alias("b_"))
    shared = F.size(F.array_intersect("a_", "b_"))
    pairs = candidates.join(a, "id").join(b, "other").withColumn("shared", shared).withColumn("similarity", F.col("shared") / (F.size("a_") + F.size("b_") - F.col("shared")))
    return pairs.where(F.col("similarity") >= limit).select("id", "other", "similarity")


def candidates(later: DataFrame, earlier: DataFrame, limit: float) -> DataFrame:
    """Distinct (id, other) of prefix rows that share a token and can reach the limit; ``other`` is earlier and of another task."""
    e = earlier.select("token", *[F.col(c).alias(f"{c}_e") for c in ("id", "task", "at", "size", "place")])
    small, large = F.least("size", "size_e"), F.greatest("size", "size_e")
    most = F.least(F.col("size") - F.col("place"), F.col("size_e") - F.col("place_e"))  # shared shingles, counted from the common one
    need = F.ceil(limit / (1 + limit) * (F.col("size") + F.col("size_e")) - F.lit(1e-9))
    # The rarest common shingle passes; a later one may not, which only drops rows that are there already.
    able = (F.col("at_e") < F.col("at")) & (F.col("task_e") != F.col("task")) & (small >= limit * large - 1e-9) & (most >= need)
    return later.join(e, "token").where(able).select("id", F.col("id_e").alias("other")).distinct()


def near_duplicates(items: DataFrame, limit: float = LIMIT, n: int = WORDS, waves: int = WAVES) -> DataFrame:
    """(id, accepted, kept_id, similarity) for items (id, task, at, text), decided in the order of ``at``; tasks follow each other in it.

    Items of one task are not compared. Rejected items name the most similar accepted one before them, the earliest at a tie.
    Texts without words are accepted. Repeated texts are near duplicates like others. ``items`` is read more than once and gives the same rows each time.
    """
    checkpoint_dir(items.sparkSession)
    some = kept(promising(items, limit, n))
    # Dealt out by id once: what is compared comes to them, wave by wave.
    slots = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sets = items.join(some, "id", "left_semi").select("id", "task", "at", shingles(F.col("text"), n).alias("h")).repartition(slots, "id").persist()
    lists = prefixes(sets, limit).checkpoint()
    kind = items.schema["id"].dataType.simpleString()
    accepted = rejected = items.sparkSession.createDataFrame([], f"id {kind}")
    left = lists
    for _ in range(waves):
        if not left.limit(1).count():
            break
        first = left.groupBy("token").agg(F.min(F.struct("at", "task")).alias("first"))
        open_ = left.join(first, "token").groupBy("id").agg(F.max(F.col("first.task") != F.col("task")).alias("behind"))
        fresh = open_.where("NOT behind").select("id").checkpoint()
        won, rest = left.join(fresh, "id", "left_semi"), left.join(fresh, "id", "left_anti")
        lost = similar(candidates(rest, won, limit), sets, limit).select("id").distinct().checkpoint()
        accepted, rejected = accepted.union(fresh).checkpoint(), rejected.union(lost).checkpoint()
        left = rest.join(lost, "id", "left_anti").checkpoint()
    if left.limit(1).count():
        more = _along_pairs(left, sets, limit)
        accepted, rejected = accepted.union(more.where("accepted").select("id")).checkpoint(), rejected.union(more.where("NOT accepted").select("id")).checkpoint()
    found = similar(candidates(lists.join(rejected, "id", "left_semi"), lists.join(accepted, "id", "left_semi"), limit), sets, limit)
    at = sets.select(F.col("id").alias("other"), F.col("at").alias("at_"))
    best = found.join(at, "other").groupBy("id").agg(F.max_by(F.struct("other", "similarity"), F.struct("similarity", -F.col("at_"))).alias("b")).checkpoint()
    sets.unpersist()
    out = items.select("id").join(best, "id", "left")
    return out.select("id", F.col("b").isNull().alias("accepted"), F.col("b.other").alias("kept_id"), F.col("b.similarity").alias("similarity"))


def _along_pairs(left: DataFrame, sets: DataFrame, limit: float) -> DataFrame:
    """(id, accepted) of items that no accepted one has rejected so far, from the similar pairs among them."""
    pairs = similar(candidates(left, left, limit), sets, limit).select("id", "other").checkpoint()
    state = left.select("id").distinct().join(pairs.select("id").distinct().withColumn("behind", F.lit(True)), "id", "left")
    state = state.select("id", F.when(F.col("behind").isNull(), F.lit(True)).alias("accepted")).checkpoint()
    while state.where("accepted IS NULL").limit(1).count():
        seen = pairs.join(state.select(F.col("id").alias("other"), F.col("accepted").alias("ok")), "other").groupBy("id").agg(
            F.max(F.coalesce("ok", F.lit(False))).alias("hit"), F.count_if(F.col("ok").isNull()).alias("open"))
        verdict = F.when(F.col("hit"), F.lit(False)).when(F.col("open") == 0, F.lit(True))
        state = state.join(seen, "id", "left").select("id", F.coalesce("accepted", verdict).alias("accepted")).checkpoint()
    return state
