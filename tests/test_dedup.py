"""Near duplicates: verdicts against brute force, and rows and comparisons that grow with the items, not their pairs."""

import random
import re

from pyspark.sql import functions as F

from spanloom.operators import dedup, shingles

ITEMS = "id int, task int, at int, text string"


def words(rnd, n):
    return [f"{rnd.choice('abcdef')}{rnd.randint(0, 400)}" for _ in range(n)]


def changed(rnd, base, times):
    w = list(base)
    for _ in range(times):
        w[rnd.randrange(len(w))] = f"new{rnd.randint(0, 10**6)}"
    return w


def runs(text, n=5):
    w = re.findall(r"[a-z0-9_]+|[一-鿿]", (text or "").lower())
    return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


def greedy(rows, limit=0.8):
    """(accepted, kept_id, similarity) of every item, task by task."""
    accepted, waiting, task, out = [], [], None, {}
    for i, k, _, t in sorted(rows, key=lambda r: r[2]):
        if k != task:
            accepted, waiting, task = accepted + waiting, [], k
        s = runs(t)
        near = [(len(s & o) / len(s | o), -at, j) for j, at, o in accepted if s and o and len(s & o) >= limit * len(s | o)]
        out[i] = (False, max(near)[2], round(max(near)[0], 9)) if near else (True, None, None)
        if not near:
            waiting.append((i, _, s))
    return out


def got(df):
    return {r.id: (r.accepted, r.kept_id, r.similarity and round(r.similarity, 9)) for r in df.collect()}


def items(seed=4, per_task=1):
    """Chains, where the middle one is like both ends; copies; a boilerplate start in many texts; short and empty texts."""
    rnd = random.Random(seed)
    texts = []
    for _ in range(10):
        w = words(rnd, rnd.choice([12, 60, 150]))
        for _ in range(rnd.randint(1, 8)):
            texts.append(" ".join(w))
            w = changed(rnd, w, max(1, len(w) // 60))
    boiler = words(rnd, 25)
    texts += [" ".join(boiler + words(rnd, 8)) for _ in range(12)] + ["", None, "a b", "a b", "a b c", "..."] + texts[:6]
    rnd.shuffle(texts)
    return [(i, i // per_task, i, t) for i, t in enumerate(texts)]


def test_near_duplicates_equal_the_greedy_order(spark):
    for per_task in (1, 3):
        rows = items(per_task=per_task)
        want = greedy(rows)
        assert sum(not v[0] for v in want.values()) > 10
        df = spark.createDataFrame(rows, ITEMS).repartition(3)
        for waves in (0, 6):
            assert got(shingles.near_duplicates(df, waves=waves)) == want, (per_task, waves)
    assert shingles.near_duplicates(spark.createDataFrame([], ITEMS)).count() == 0


def test_cluster_of_near_copies_gives_rows_in_proportion(spark, monkeypatch):
    """Candidates of n near copies: each meets the accepted one, in the waves and in the last comparison."""
    rnd = random.Random(2)
    base = words(rnd, 200)
    met = []
    plain = shingles.similar

    def counted(rows, *rest):
        met.append(rows.count())
        return plain(rows, *rest)

    monkeypatch.setattr(shingles, "similar", counted)
    sizes = {}
    for n in (40, 80):
        met.clear()
        rows = [(k, k, k, " ".join(changed(rnd, base, 2) if k else base)) for k in range(n)]
        verdict = got(shingles.near_duplicates(spark.createDataFrame(rows, ITEMS)))
        assert [i for i, v in verdict.items() if v[0]] == [0]
        sizes[n] = sum(met)
    assert sizes[40] <= 2 * 40 and sizes[80] <= 2 * 80


def test_sets_of_texts_without_a_similar_one_are_not_moved(spark, monkeypatch):
    """A common line alone keeps no text; every pair at the limit is kept, whatever the limit."""
    rnd = random.Random(6)
    line = words(rnd, 12)
    base = words(rnd, 120)
    rows = [(k, k, k, " ".join(line + words(rnd, 120))) for k in range(60)] + [(k, k, k, " ".join(changed(rnd, base, 1))) for k in range(60, 64)]
    seen = []
    plain = shingles.prefixes
    monkeypatch.setattr(shingles, "prefixes", lambda sets, limit: (seen.extend(r.id for r in sets.select("id").collect()), plain(sets, limit))[1])
    assert got(shingles.near_duplicates(spark.createDataFrame(rows, ITEMS))) == greedy(rows)
    assert sorted(seen) == [60, 61, 62, 63]
    rows = items(seed=8)
    sets = {i: runs(t) for i, _, _, t in rows}
    df = spark.createDataFrame(rows, ITEMS)
    for limit in (0.05, 0.4, 0.8, 1.0):
        want = {i for i, a in sets.items() for j, b in sets.items() if i != j and a and b and len(a & b) >= limit * len(a | b)}
        assert want and want <= {r.id for r in shingles.promising(df, limit, 5).collect()}
        assert got(shingles.near_duplicates(df, limit)) == greedy(rows, limit)


def test_ratio_rows_in_proportion(spark):
    """n near copies by matching blocks: one row per item and block of earlier items."""
    rnd = random.Random(3)
    base = " ".join(words(rnd, 40))
    rows = [(k, k, k, base + f" {rnd.randint(100, 999)}") for k in range(48)] + [(100, 100, 100, " ".join(words(rnd, 500)))]
    df = spark.createDataFrame(rows, ITEMS).dropDuplicates(["text"])
    n = df.count()
    hits = dedup.similar_items(df, df.withColumn("accepted", F.lit(False)), block=n)
    cores = spark.sparkContext.defaultParallelism
    assert n - 2 <= hits.count() <= n * (cores + 1)
    verdict = {r.id: r.accepted for r in dedup.greedy_dedup(df).collect()}
    assert sum(verdict.values()) == 2 and verdict[100]


def test_length_bands_lose_no_pair():
    """Lengths of a pair at the limit lie in the same band or in neighbours."""
    import math

    for limit in (0.5, 0.8, 0.92, 0.99):
        wide = (2 - limit) / limit + 1e-9
        for a in range(1, 3000, 7):
            b = math.floor(a * (2 - limit) / limit)  # the longest text that can reach the limit with a characters
            assert 2 * a / (a + b) >= limit - 1e-12
            assert abs(math.floor(math.log(a + 1) / math.log(wide)) - math.floor(math.log(b + 1) / math.log(wide))) <= 1


def test_texts_are_dealt_out_once_for_all_blocks_they_meet(spark, monkeypatch):
    """Forty texts of one length in blocks of four: every pair meets, each side goes out once."""
    sent, meet_all = [], dedup.meet_all
    monkeypatch.setattr(dedup, "meet_all", lambda asked, held, *a: sent.append((asked.count(), held.count())) or meet_all(asked, held, *a))
    texts = [f"{chr(97 + k % 20) * 30} {chr(65 + k % 20) * 30} end{k // 20}" for k in range(40)]
    items = spark.createDataFrame([(f"i{k}", f"t{k}", k, t, True) for k, t in enumerate(texts)], "id string, task string, at long, text string, accepted boolean")
    found = dedup.similar_items(items.drop("accepted"), items, 0.92, block=4)
    assert sorted((r.id, r.earlier_id) for r in found.collect()) == sorted((f"i{k}", f"i{k - 20}") for k in range(20, 40)) and sent == [(40, 40)]
