"""Vectors grouped around centroids, the nearest one found in a vantage-point tree, all in whole numbers.

Components become floor(scale * x). Each round builds a vantage-point tree over the centroids and broadcasts it: its size is that
of the centroids, which parameters bound (``LARGEST``). Every vector searches the tree best first by itself: of its open branches
it takes the one with the least possible distance, measures the vantage centroid, and opens the branches inside and outside whose
bound does not exceed the best distance so far. The bound is inclusive, so a branch that can only tie is still visited and ties go
to the smaller number. A batch of vectors walks in step, each in its own order. Tasks send one sum per centroid and component, so a
round shuffles nothing that grows with the vectors of a group; a cluster may hold all rows.

Vectors that are NULL, of another length, or hold NULL or non-finite entries are left out. NULL ids keep their vector, which can
seed a centroid only where ids run out. Repeated rows count each. Fewer vectors than centroids make fewer centroids. An empty table
gives no rows. Components beyond ``REACH`` raise an error, because squared distances would leave the range of long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .dense import finite, matrix, summed
from .shared import stored

SCALE = 1024
REACH = 1 << 27
LARGEST = 256 << 20
BATCH = 2048
LEAF = 2


# A vantage centroid (or the centroids of a leaf) and its branches: (node, least and largest distance from the vantage centroid).
Node = tuple[list[int], list[tuple[int, float, float]]]


def squared(rows: np.ndarray, point: np.ndarray) -> np.ndarray:
    d = rows - point
    return np.einsum("ij,ij->i", d, d)


def vantage_tree(points: np.ndarray, leaf: int = LEAF) -> list[Node]:
    """Nodes, the root first. The vantage point of a part is the one whose distances to the rest spread most; the median splits."""
    nodes: list[Node] = []

    def build(ids: np.ndarray) -> int:
        at = len(nodes)
        nodes.append(([], []))
        if len(ids) <= leaf:
            nodes[at][0].extend(ids.tolist())
            return at
        tried = ids if len(ids) <= 32 else ids[np.linspace(0, len(ids) - 1, 32).astype(int)]
        vantage = max(tried.tolist(), key=lambda i: (np.sqrt(squared(points[ids], points[i]).astype(float)).std(), -i))
        nodes[at][0].append(vantage)
        rest = ids[ids != vantage]
        d = np.sqrt(squared(points[rest], points[vantage]).astype(float))
        inside = d <= np.median(d)
        for part in (inside, ~inside):
            if part.any():
                nodes[at][1].append((build(rest[part]), float(d[part].min()), float(d[part].max())))
        return at

    if len(points):
        build(np.arange(len(points)))
    return nodes


def nearest(vectors: np.ndarray, points: np.ndarray, nodes: list[Node]) -> tuple[np.ndarray, np.ndarray]:
    """The nearest point of every vector and its squared distance, ties to the smaller number."""
    n = len(vectors)
    best, found = np.full(n, np.iinfo(np.int64).max), np.full(n, len(points))
    bound = np.full((n, len(nodes)), np.inf)
    bound[:, 0] = 0.0
    active = np.arange(n)
    while len(active):
        take = bound[active].argmin(axis=1)
        least = bound[active, take]
        go = np.isfinite(least) & (least <= np.sqrt(best[active].astype(float)))
        active, take = active[go], take[go]
        bound[active, take] = np.inf
        for k in np.unique(take):
            rows, (members, branches) = active[take == k], nodes[k]
            for m in members:
                d = squared(vectors[rows], points[m])
                closer = (d < best[rows]) | ((d == best[rows]) & (m < found[rows]))
                best[rows[closer]], found[rows[closer]] = d[closer], m
            if branches:
                root = np.sqrt(d.astype(float))
                for child, low, high in branches:
                    slack = 1e-14 * (root + high)  # above the rounding error of roots and differences, so no tie is cut off
                    bound[rows, child] = np.maximum(0.0, np.maximum(low - root, root - high) - slack)
    return found, best


def whole(df: DataFrame, key: str, vector: str, width: int, scale: int = SCALE) -> DataFrame:
    """id and components as whole numbers of the vectors that take part."""
    parts = F.transform(F.col(f"`{vector}`"), lambda x: F.floor(x.cast("double") * scale))
    usable = (F.size(f"`{vector}`") == width) & finite(F.col(f"`{vector}`"))
    return df.where(usable).select(F.col(f"`{key}`").alias("id"), parts.alias("v"))


def seeds(vectors: DataFrame, k: int, salt: str) -> np.ndarray:
    """The k vectors of least sha256 of salt and id."""
    mark = F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256)
    rows = vectors.select(mark.alias("h"), "v").orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()
    return np.array([r["v"] for r in rows], np.int64)


def _batches(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH):
            part = batch.slice(at, BATCH)
            rows = matrix(part.column("v"), width, np.int64)
            if rows.size and (rows.max() > REACH or rows.min() < -REACH):
                raise ValueError(f"components beyond {REACH} have squared distances that long cannot hold")
            yield part, rows


def _sent(vectors: DataFrame, points: np.ndarray):
    if points.nbytes > LARGEST:
        raise ValueError(f"{points.nbytes} bytes of centroids; at most {LARGEST} are broadcast")
    return vectors.sparkSession.sparkContext.broadcast((points, vantage_tree(points)))


def move(vectors: DataFrame, points: np.ndarray) -> np.ndarray:
    """The centroids after one round: the floor of the exact mean of their vectors; empty ones stay."""
    sent, (k, width) = _sent(vectors, points), points.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros((k, width + 1), np.int64)
        for _, rows in _batches(batches, width):
            home, _ = nearest(rows, *sent.value)
            np.add.at(total[:, :width], home, rows)
            total[:, width] += np.bincount(home, minlength=k)
        return total

    total = summed(vectors, sums, "long")
    out = points.copy()
    for c in range(k):
        n = total.get(c * (width + 1) + width, 0)
        if n:
            out[c] = [total.get(c * (width + 1) + j, 0) // n for j in range(width)]
    sent.unpersist()
    return out


def assign(vectors: DataFrame, points: np.ndarray) -> DataFrame:
    """id, cluster and squared distance of every vector."""
    sent, width = _sent(vectors, points), points.shape[1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in _batches(batches, width):
            home, d = nearest(rows, *sent.value)
            yield pa.record_batch([part.column("id"), pa.array(home.astype(np.int32)), pa.array(d)], names=["id", "cluster", "distance"])

    kind = vectors.schema["id"].dataType.simpleString()
    return vectors.mapInArrow(place, f"id {kind}, cluster int, distance long")


def clustered(df: DataFrame, key: str, vector: str, width: int, k: int = 8, rounds: int = 10, salt: str = "3:") -> DataFrame:
    """key, cluster, distance, the sums of distances and the centroid's checksum of every vector that takes part."""
    spark = df.sparkSession
    vectors = stored(whole(df, key, vector, width))
    points = seeds(vectors, k, salt)
    kind = vectors.schema["id"].dataType.simpleString()
    if not len(points):
        return spark.createDataFrame([], f"`{key}` {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        points = move(vectors, points)
    placed = stored(assign(vectors, points))
    inertia = {r["cluster"]: int(r["d"]) for r in placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    marks = [hashlib.sha256(",".join(map(str, p)).encode()).hexdigest() for p in points.tolist()]
    table = spark.createDataFrame([(c, inertia.get(c, 0), sum(inertia.values()), marks[c]) for c in range(len(points))], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    out = placed.join(F.broadcast(table), "cluster")  # one row per centroid, whose size _sent has checked
    return out.select(F.col("id").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings of 64 components around 8 centroids."""
    return clustered(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding", 64)


def _statement(k: int = 8, rounds: int = 10) -> str:
    """The same rounds in DuckDB, one expression per round."""
    steps = [f"""
v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h) - 1 AS INTEGER) AS c, x FROM (SELECT sha256('3:' || vec_id) AS h, x FROM v ORDER BY h LIMIT {k}))"""]
    home = """(SELECT vec_id, x, unnest(best) FROM (SELECT v.vec_id, v.x, min({{'d': list_sum(list_transform(list_zip(v.x, c.x), lambda z: CAST((z[1] - z[2]) * (z[1] - z[2]) AS BIGINT))), 'c': c.c}}) AS best
  FROM v, {c} c GROUP BY v.vec_id, v.x))"""
    for r in range(rounds):
        steps.append(f"""
c{r + 1} AS MATERIALIZED (SELECT c0.c, coalesce(m.x, c0.x) AS x FROM c{r} c0 LEFT JOIN (
  SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS x FROM (
    SELECT c, j, sum(e) AS s, count(*) AS n FROM (SELECT c, unnest(x) AS e, generate_subscripts(x, 1) AS j FROM {home.format(c=f"c{r}")}) GROUP BY c, j) GROUP BY c) m ON m.c = c0.c)""")
    return f"""WITH {",".join(steps)}, placed AS MATERIALIZED {home.format(c=f"c{rounds}")}
SELECT vec_id, p.c AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY p.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(f.x, ',')) AS centroid_sha256
FROM placed p JOIN c{rounds} f ON f.c = p.c"""


QUERIES = {"op11_centroid_clustering": op11_centroid_clustering}
STATEMENTS = {"op11_centroid_clustering": _statement()}
