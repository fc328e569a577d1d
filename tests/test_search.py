"""Pruned searches against brute force, and how much of the pool they see."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.catalog import queries
from spanloom.operators import retrieval, setjoin
from spanloom.operators.blocks import round_half_even
from spanloom.operators.setjoin import SetIndex
from spanloom.operators.vectorjoin import VectorIndex


def jaccard(a, b):
    return len(a & b) / max(1, len(a | b))


def token_rows(n=160, seed=3):
    """(id, tokens, hard): one token in every text, a third exact copies, near copies, empty sets."""
    rnd = random.Random(seed)
    base = [{"all"} | {f"t{int(rnd.paretovariate(0.7))}" for _ in range(rnd.randint(1, 25))} for _ in range(n)]
    rows = []
    for k in range(n):
        v = set(base[0]) if k % 3 == 0 else set(base[k]) | ({f"x{k}"} if k % 5 == 0 else set(base[k - 1]) if k % 7 == 0 else set())
        rows.append((f"s{k:03d}", sorted(set() if k in (11, 12) else v), k % 4 == 0))
    return rows


def sets(spark, rows):
    return spark.createDataFrame(rows, "id string, v array<string>, hard boolean").repartition(4)


def expected(queries, pool, k, key, round_to, drop_self):
    out = set()
    for i, v, _ in queries:
        scored = [(float(round_half_even(np.float64(jaccard(set(v), set(w))), round_to)), j, h) for j, w, h in pool if not (drop_self and i == j)]
        out |= {(i, j, s, r + 1) for r, (s, j, h) in enumerate(sorted(scored, key=key)[:k])}
    return out


def result(df):
    return {(r.query_id, r.example_id, r.score, r["rank"]) for r in df.collect()}


DESC = {c: chr(0x10FFFF - ord(c)) for c in map(chr, range(32, 127))}


def down(text):
    return "".join(DESC[c] for c in text)


@pytest.mark.parametrize("k, round_to, drop_self", [(3, 4, True), (5, None, False), (400, 1, True)])
def test_nearest_sets(spark, k, round_to, drop_self):
    rows = token_rows()
    got = SetIndex(sets(spark, rows), block_rows=16).nearest(sets(spark, rows), k, [("id", True)], round_to, drop_self)
    assert result(got) == expected(rows, rows, k, lambda x: (-x[0], x[1]), round_to, drop_self)


def test_nearest_sets_with_ties_by_two_columns(spark):
    rows, queries = token_rows(), token_rows(40, 8)
    got = SetIndex(sets(spark, rows), block_rows=16).nearest(sets(spark, queries), 4, [("hard", False), ("id", False)], None, False)
    assert result(got) == expected(queries, rows, 4, lambda x: (-x[0], not x[2], down(x[1])), None, False)


@pytest.mark.parametrize("front", [4, 1000])
def test_farthest_sets(spark, front):
    """Queries with and without sets that share nothing with them."""
    rows = token_rows()
    plain = [(i, [t for t in v if t != "all"] if k % 2 else v, h) for k, (i, v, h) in enumerate(rows)]
    for pool in (rows, plain):
        got = SetIndex(sets(spark, pool), block_rows=16).farthest(sets(spark, pool), 5, 4, front=front)
        assert result(got) == expected(pool, pool, 5, lambda x: (x[0], x[1]), 4, True)


def test_sets_of_small_pools(spark):
    none, one = sets(spark, []), sets(spark, [("a", ["x"], True)])
    assert SetIndex(none).nearest(one, 3, [("id", True)]).count() == 0 and SetIndex(one).nearest(none, 3, [("id", True)]).count() == 0
    assert SetIndex(one).nearest(one, 3, [("id", True)]).count() == 0 and SetIndex(one).nearest(one, 0, [("id", True)]).count() == 0
    assert result(SetIndex(one).nearest(one, 3, [("id", True)], drop_self=False)) == {("a", "a", 1.0, 1)}
    assert SetIndex(none).farthest(one, 3).count() == 0


def test_contrastive_and_examples_equal_the_grid(spark):
    rows = token_rows(60)
    t = sets(spark, rows)
    found = retrieval.grid_best(t, t, retrieval.jaccard_scores, 3, far=4)
    near = {(r.query_id, r.example_id) for r in retrieval.top_k(found.select("query_id", "example_id", "score").distinct(), ["query_id"], [F.desc("score"), "example_id"], 3).collect()}
    got = retrieval.contrastive_select(t, t, 3, 1).collect()
    assert {(r.query_id, r.example_id) for r in got if r.role == "similar"} == near and sum(r.role == "boundary" for r in got) == 60
    picks = retrieval.select_examples(t, t, 3).collect()
    assert len(picks) == 180 and all(any(p.hard for p in picks if p.query_id == i) for i, _, _ in rows)


def test_blocks_seen_follow_the_answers(spark):
    """Groups of alike texts that all share one token: a query sees the blocks of its group, and twice the pool does not double them."""
    rnd = random.Random(1)

    def pool(groups):
        words = [[f"g{g}w{k}" for k in range(30)] for g in range(groups)]
        return sets(spark, [(f"{g:03d}-{k:02d}", ["all", "of", *rnd.sample(words[g], 25)], False) for g in range(groups) for k in range(16)])

    seen = {}
    for groups in (24, 48):
        index = SetIndex(p := pool(groups), block_rows=64)
        assert index.nearest(p, 3, [("id", True)]).count() == groups * 16 * 3
        seen[groups] = index.visits.count() / (groups * 16)
        blocks = index.sets.select("block").distinct().count()
        assert seen[groups] < 0.5 * blocks
    assert seen[48] < 1.5 * seen[24] + 0.5


def vector_rows(n=200, width=6, seed=2):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, width))
    x[: n // 3] = x[0]
    x[n // 2 : n // 2 + 10] = 0
    x[::5] *= 3
    return [(f"v{k:03d}", [float(c) for c in v]) for k, v in enumerate(x)]


@pytest.mark.parametrize("k, round_to, drop_self, pivots", [(4, 4, True, 12), (7, None, False, 12), (5, 1, True, 1), (500, 4, True, 12)])
def test_nearest_vectors(spark, k, round_to, drop_self, pivots):
    rows = vector_rows()
    df = spark.createDataFrame(rows, "id string, v array<double>").repartition(4)
    got = {}
    for r in VectorIndex(df, pivots, block_rows=16).nearest(df, k, round_to, drop_self).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.example_id, r.score)
    for i, v in rows:
        scored = sorted((-float(round_half_even((np.array(w) * np.array(v)).sum(), round_to)), j) for j, w in rows if not (drop_self and i == j))[:k]
        assert [got[i][r + 1] for r in range(len(scored))] == [(j, -s) for s, j in scored]


def test_vectors_of_small_pools(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0])], "id string, v array<double>")
    assert VectorIndex(df.where("false")).nearest(df, 3).count() == 0 and VectorIndex(df).nearest(df, 3).count() == 0
    assert VectorIndex(df).nearest(df.where("false"), 3, None, False).count() == 0
    assert [tuple(r) for r in VectorIndex(df).nearest(df, 3, None, False).collect()] == [("a", "a", 1.0, 1)]


def test_cells_seen_follow_the_answers(spark):
    """Groups of near vectors: after the first round few cells can still win."""
    rng = np.random.default_rng(7)
    centres = rng.standard_normal((40, 16))
    x = centres[np.arange(800) % 40] + 0.02 * rng.standard_normal((800, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([(k, [float(c) for c in v]) for k, v in enumerate(x)], "id long, v array<double>")
    index = VectorIndex(df, pivots=64)
    found = {(r.query_id, r.example_id) for r in index.nearest(df, 5).collect()}
    blocks = int(index.cells.blocks.sum())
    assert index.visits.count() < 0.15 * 800 * blocks
    for i in range(0, 800, 37):
        s = x @ x[i]
        s[i] = -9
        assert {j for q, j in found if q == i} <= set(np.flatnonzero(s >= np.sort(s)[-6] - 1e-4).tolist())


@pytest.mark.parametrize("name, column", [("query_index", "query_id"), ("contrastive_examples", "query_id"), ("select_examples", "query_id"), ("context_pack", "task_id")])
def test_every_row_asks(spark, folder, name, column):
    """No id is divisible by 100, and all rows are queries."""
    ids, rng = range(1, 13), np.random.default_rng(5)
    docs = [(k, f"heart failure care w{k} w{k + 1} w{k + 2}", "en", "web", 20) for k in ids]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, 1, k % 2) for k in ids], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(k, [float(x) for x in rng.standard_normal(4)], 0) for k in ids], "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    got = {r[0] for r in queries()[name](spark, folder).select(column).distinct().collect()}
    assert got == {f"s{k:08d}" for k in ids}


def test_vectors_do_not_go_with_every_cell_they_see(spark):
    """Random vectors: nearly all cells are seen, but pairs of blocks are made inside the tasks and each side is shuffled once."""
    rng = np.random.default_rng(11)
    df = spark.createDataFrame([(k, [float(c) for c in v]) for k, v in enumerate(rng.standard_normal((600, 8)))], "id long, v array<double>")
    index = VectorIndex(df, pivots=40)
    found = index.nearest(df, 5)
    assert index.visits.count() > 600 * 20 and index.visits.columns == ["id", "block"]
    physical = found._jdf.queryExecution().executedPlan().toString()
    assert physical.count("CartesianProduct") == 1 and "FlatMapCoGroups" not in physical and found.count() == 3000


def test_sets_are_shuffled_for_their_first_blocks_only(spark, monkeypatch):
    """Sets that all share a token see nearly all blocks; what is dealt out for that are the sets themselves, once."""
    rows = token_rows(200, 4)
    sent, meet, meet_all = [], setjoin.meet, setjoin.meet_all
    monkeypatch.setattr(setjoin, "meet", lambda asked, *a: sent.append(asked.count()) or meet(asked, *a))
    monkeypatch.setattr(setjoin, "meet_all", lambda asked, *a: sent.append(asked.count()) or meet_all(asked, *a))
    index = SetIndex(t := sets(spark, rows), block_rows=8)
    assert result(index.nearest(t, 3, [("id", True)], 4)) == expected(rows, rows, 3, lambda x: (-x[0], x[1]), 4, True)
    assert index.visits.count() > 1000 and sent[0] <= 200 * setjoin.FIRST_BLOCKS and sent[1:] == [200]
