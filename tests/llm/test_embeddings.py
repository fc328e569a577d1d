"""Clustering, neighbour search and whitening against plain restatements, on the given tables and on odd rows."""

import hashlib
import math

import numpy as np
import pytest

from spanloom.llm import bidiagonal, centroids, neighbours, whitening

SF = "/root/testdata/sf0.01"
NAN, INF = float("nan"), float("inf")


def rows(n: int = 300, width: int = 8, seed: int = 5) -> list[tuple]:
    """(vec_id, embedding): a hot vector held by a third of the rows, near copies, repeated rows, and everything that is left out."""
    rng = np.random.default_rng(seed)
    made = rng.standard_normal((n, width))
    made[: n // 3] = made[0]
    made[n // 3 : n // 2] = made[-1] + 0.01 * rng.standard_normal((n // 2 - n // 3, width))
    good = [(k, [float(x) for x in np.float32(v)]) for k, v in enumerate(made)]
    odd = [(1000, None), (1020, []), (1040, [1.0] * (width - 1)), (1060, [NAN] * width), (1080, [INF] + [0.0] * (width - 1)), (1100, [None] + [0.5] * (width - 1)), (1120, [0.0] * width)]
    return [*good, good[7], good[20], (None, good[9][1]), *odd]


def table(spark, data, extra: bool = True):
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>").repartition(5)
    if extra:
        for name in ("id", "v", "row", "cluster", "part", "block", "w", "component", "rank", "score", "query", "at", "x"):
            df = df.selectExpr("*", f"'clash' AS {name}")
    return df


def usable(data, width=8):
    return [(i, v) for i, v in data if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]


def lloyd(data, k=8, rounds=10, salt="3:"):
    """(vec_id, cluster, distance) of each row and the centroids, in Python's integers."""
    kept = [(i, tuple(math.floor(1024 * x) for x in v)) for i, v in usable(data)]
    order = sorted((i is None, "" if i is None else hashlib.sha256(f"{salt}{i}".encode()).hexdigest(), v) for i, v in kept)
    points = [list(v) for _, _, v in order[:k]]
    home = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, p)), c) for c, p in enumerate(points))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(home(v)[1], []).append(v)
        for c, g in groups.items():
            points[c] = [sum(x) // len(g) for x in zip(*g)]
    return [(i, home(v)[1], home(v)[0]) for i, v in kept], points


def order(x):
    return (x[0] is None, x[0] or 0, *x[1:])


def test_clusters_equal_whole_number_rounds(spark):
    data = rows()
    want, points = lloyd(data)
    got = centroids.clustered(table(spark, data), "vec_id", "embedding", 8).collect()
    assert sorted(((r["vec_id"], r["cluster"], r["distance"]) for r in got), key=order) == sorted(want, key=order)
    total = sum(d for _, _, d in want)
    for r in got:
        assert r["inertia"] == total and r["cluster_inertia"] == sum(d for _, c, d in want if c == r["cluster"])
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, points[r["cluster"]])).encode()).hexdigest()


def test_clusters_of_small_tables(spark):
    assert centroids.clustered(table(spark, []), "vec_id", "embedding", 8).count() == 0
    assert centroids.clustered(table(spark, [(1, None), (2, [NAN])]), "vec_id", "embedding", 8).count() == 0
    got = centroids.clustered(table(spark, [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 2.0])]), "vec_id", "embedding", 2).collect()
    assert {(r["distance"], r["inertia"]) for r in got} == {(0, 0)} and len(got) == 3
    assert len({r["cluster"] for r in got if r["vec_id"] != 3}) == 1  # equal centroids: the smaller number takes both
    with pytest.raises(Exception, match="squared distances"):
        centroids.clustered(table(spark, [(1, [1e9, 0.0]), (2, [0.0, 0.0])]), "vec_id", "embedding", 2).count()


@pytest.mark.parametrize("k", [1, 2, 3, 8, 40, 300])
@pytest.mark.parametrize("reach", [2, 1000])
def test_vantage_tree_is_exact_with_ties(k, reach):
    rng = np.random.default_rng(k)
    points, v = rng.integers(-reach, reach, (k, 3)), rng.integers(-reach, reach, (700, 3))
    home, d = centroids.nearest(v, points, centroids.vantage_tree(points))
    all_ = ((v[:, None] - points[None]) ** 2).sum(2)
    assert (home == all_.argmin(1)).all() and (d == all_.min(1)).all()


def test_vantage_tree_prunes():
    """Tight groups far apart: most centroids are never measured."""
    rng = np.random.default_rng(2)
    points = np.repeat(rng.integers(-100_000, 100_000, (64, 6)), 4, axis=0) + rng.integers(-5, 5, (256, 6))
    measured, plain = [], centroids.squared

    def counted(part, point):
        measured.append(len(part))
        return plain(part, point)

    nodes = centroids.vantage_tree(points)
    centroids.squared = counted
    try:
        centroids.nearest(points[rng.integers(0, 256, 500)], points, nodes)
    finally:
        centroids.squared = plain
    assert sum(measured) < 0.5 * 500 * 256


def nearest(data, k, every, width=8):
    kept = [(i, np.array(v, float)) for i, v in usable(data, width) if any(v)]
    out = {}
    for a, (i, q) in enumerate(kept):
        if i is not None and i % every == 0:
            found = sorted(((-float((q * x).sum()), j is None, j or 0, b) for b, (j, x) in enumerate(kept) if b != a))[:k]
            out.setdefault(i, []).append([(None if none else j, -s) for s, none, j, _ in found])
    return out


def answers(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return out


def test_neighbours_of_odd_rows(spark):
    """Recall over all queries, ranks without gaps, exact scores, ties to the smaller id; id 20 is there twice and asks twice."""
    data = rows()
    want = nearest(data, 10, 20)
    got = answers(neighbours.search(table(spark, data), "vec_id", "embedding", 10, 20))
    assert got.keys() == want.keys()
    hits = 0
    for i, lists in want.items():
        assert sorted(r for r, _, _ in got[i]) == sorted(list(range(1, 11)) * len(lists))
        pairs = [(j, s) for _, j, s in got[i]]
        hits += sum(min(pairs.count(p), sum(x.count(p) for x in lists)) for p in set(pairs))
        if len(lists) == 1:
            assert [(-s, j is None, j or 0) for j, s in pairs] == sorted((-s, j is None, j or 0) for j, s in pairs)
    assert hits >= 0.9 * sum(10 * len(x) for x in want.values())


def test_neighbours_of_small_tables(spark):
    none = neighbours.search(table(spark, []), "vec_id", "embedding", 5, 20)
    assert none.columns == ["query_id", "rank", "vec_id", "score"] and none.count() == 0
    assert neighbours.search(table(spark, [(20, None), (40, [0.0])]), "vec_id", "embedding", 5, 20).count() == 0
    few = [(20, [1.0, 0.0]), (3, [0.5, 0.5]), (4, [-1.0, 0.0]), (5, [0.5, 0.5])]
    assert answers(neighbours.search(table(spark, few), "vec_id", "embedding", 5, 20)) == {20: [(1, 3, 0.5), (2, 5, 0.5), (3, 4, -1.0)]}
    assert neighbours.search(table(spark, [(20, [1.0, 0.0])]), "vec_id", "embedding", 5, 20).count() == 0
    assert neighbours.search(table(spark, [(21, [1.0, 0.0]), (22, [1.0, 0.0])]), "vec_id", "embedding", 5, 20).count() == 0


def test_neighbours_of_vectors_of_many_lengths(spark):
    """Inner products, not angles: long vectors win."""
    rng = np.random.default_rng(4)
    data = [(k, [float(x) for x in np.float32(v * 10 ** rng.uniform(-1, 1))]) for k, v in enumerate(rng.standard_normal((400, 8)))]
    want, got = nearest(data, 10, 20), answers(neighbours.search(table(spark, data), "vec_id", "embedding", 10, 20))
    assert sum(len({j for _, j, _ in got[i]} & {j for j, _ in want[i][0]}) for i in want) >= 0.9 * 10 * len(want)


def test_split_blocks_and_parts_give_the_same(spark, monkeypatch):
    data = rows()
    one = answers(neighbours.search(table(spark, data), "vec_id", "embedding", 10, 20))
    monkeypatch.setattr(neighbours, "BLOCK", 16)
    monkeypatch.setattr(neighbours, "PART", 3)
    assert answers(neighbours.search(table(spark, data), "vec_id", "embedding", 10, 20)) == one


def test_neighbours_recall_on_given_table(spark):
    data = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want, got = nearest(data, 20, 20, 64), answers(neighbours.op12_nearest_neighbours(spark, SF))
    assert sum(len({j for _, j, _ in got[i]} & {j for j, _ in want[i][0]}) for i in want) >= 0.9 * 20 * len(want)
    for i, found in got.items():
        assert [r for r, _, _ in found] == list(range(1, 21)) and all(j != i for _, j, _ in found)


def test_buckets_are_visited_in_success_order(spark):
    """A query near a hot group looks at fewer rows than there are."""
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((40, 16))
    centres /= np.linalg.norm(centres, axis=1)[:, None]
    data = [(k, [float(x) for x in centres[k % 40] + 0.01 * rng.standard_normal(16)]) for k in range(2000)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    vectors = neighbours.usable(df, "vec_id", "embedding", 16, 20).cache()
    index = neighbours.fit(vectors, 16, 2000, 4)
    assert neighbours.calibrate(vectors, index, 16, 10) >= neighbours.TARGET
    q = np.array([v for _, v in data[:200:20]])
    seen = sum(index.filled[t][b].sum() for _, t, b in index.visited(q, 10))
    assert seen < 0.4 * len(q) * 2000 * neighbours.TABLES
    for order, before in index.order(q):
        share = np.diff(np.concatenate([before, np.ones((len(q), 1))], axis=1), axis=1)
        assert (share[:, :-1] >= share[:, 1:] - 1e-9).all() and (np.sort(order, axis=1) == np.arange(order.shape[1])).all()


def whiten(data, width, most=32):
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for _, v in usable(data, width)], np.int64)
    n, total = len(x), x.sum(0)
    y = (n * x - total) / n
    e, z = np.linalg.eigh(y.T @ y / n)
    e, z = e[::-1], z[:, ::-1]
    keep = [j for j in range(min(most, width)) if e[j] > 1e-9 * e[0]]
    return ((n * x - total) ** 2).sum(1), y @ z[:, keep] / np.sqrt(e[keep]), e[keep] / e.sum()


def close(got, ids, deviation, want, share):
    by = {}
    for r in got:
        by.setdefault((r["vec_id"], int(r["deviation"])), []).append(r)
    sign = {}
    for i, d, w in zip(ids, deviation.tolist(), want):
        cells = sorted(by[i, d], key=lambda r: r["component"])
        for c in range(len(w)):
            same = [r["whitened"] for r in cells if r["component"] == c + 1]
            if c not in sign and abs(w[c]) > 1e-3:
                sign[c] = np.sign(same[0] * w[c])
            assert any(abs(s * sign.get(c, 1) - w[c]) < 1e-7 for s in same), (i, c, same, w[c])
    for r in got:
        assert abs(r["explained"] / share[r["component"] - 1] - 1) < 1e-9 and r["identity_error"] < 1e-9


def test_whitening_of_odd_rows(spark):
    data = rows()
    deviation, want, share = whiten(data, 8)
    got = whitening.whitened(table(spark, data), "vec_id", "embedding").collect()
    kept = usable(data)
    assert len(got) == len(kept) * want.shape[1] and {r["n"] for r in got} == {len(kept)}
    close(got, [i for i, _ in kept], deviation, want, share)


def test_whitening_of_given_table(spark):
    data = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    deviation, want, share = whiten(data, 64)
    got = whitening.op13_embedding_whitening(spark, SF).collect()
    assert len(got) == len(data) * 32
    close(got, [i for i, _ in data], deviation, want, share)


def test_whitening_without_variance(spark):
    for data in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        assert whitening.whitened(table(spark, data), "vec_id", "embedding").count() == 0
    got = whitening.whitened(table(spark, [(k, [float(k), 1.0, 2.0 * k]) for k in range(9)]), "vec_id", "embedding").collect()
    assert {r["component"] for r in got} == {1} and abs(got[0]["explained"] - 1) < 1e-12  # one direction has all the variance


def test_deviation_beyond_64_bits():
    big = np.array([[1 << 40], [-(1 << 40)]], np.int64)
    assert whitening.scaled(big, 1 << 30, [0])[0, 0] == 1 << 70


def test_triangles_are_merged(spark, monkeypatch):
    monkeypatch.setattr(whitening, "MERGED", 2)
    df = whitening.whole(table(spark, rows()), "vec_id", "embedding", 8).repartition(7).cache()
    n, total = whitening.sums(df, 8)
    r = whitening.triangle(df, n, total)
    y = np.array([[n * (math.floor(64 * c) + 1_000_000) for c in v] for _, v in usable(rows())]) - np.array(total)
    assert np.allclose(r.T @ r, (y / n).T @ (y / n), rtol=1e-12, atol=1e-9)


def shapes():
    rng = np.random.default_rng(0)
    q = np.linalg.qr(rng.standard_normal((40, 40)))[0]
    lack = rng.standard_normal((200, 40))
    lack[:, 5], lack[:, 7], lack[:, 30:] = 0, lack[:, 8], 0
    return {
        "plain": rng.standard_normal((500, 40)), "graded": rng.standard_normal((500, 40)) * np.logspace(0, -6, 40), "identity": np.eye(40), "lacking": lack,
        "equal": np.sqrt(np.r_[np.full(15, 3.0), np.full(10, 2.0), np.ones(15)])[:, None] * q, "close": np.sqrt(np.r_[3 + 1e-9 * np.arange(15), 2 + 1e-13 * np.arange(10), np.ones(15)])[:, None] * q,
        "few": rng.standard_normal((3, 40)), "one": rng.standard_normal((9, 1)), "zero": np.zeros((5, 4)),
    }


@pytest.mark.parametrize("name", list(shapes()))
def test_directions(name):
    """Values to high relative accuracy, orthogonal vectors, small residuals; also for equal, close and missing values."""
    a = shapes()[name]
    width = a.shape[1]
    r = np.zeros((width, width))
    upper = np.linalg.qr(a, mode="r")
    r[: len(upper)] = upper
    e, z, total = bidiagonal.directions(r, width)
    want = np.linalg.svd(a, compute_uv=False) ** 2
    rank = int((want > 1e-24 * want[0]).sum()) if want[0] else 0
    assert len(e) == rank and abs(total - want.sum()) <= 1e-12 * want.sum()
    if rank:
        assert np.allclose(e, want[:rank], rtol=1e-10 if name == "graded" else 1e-12, atol=0)
        assert np.abs(z.T @ z - np.eye(rank)).max() < 1e-9
        assert np.abs(a.T @ (a @ z) - z * e).max() < 1e-10 * e[0]
