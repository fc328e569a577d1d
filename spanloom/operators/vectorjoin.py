"""Exact nearest vectors by inner product, with pivots, radii and the triangle inequality.

Pool vectors belong to the nearest of a bounded number of pivots. Of each pivot's cell the largest distance to the pivot and the
range of lengths are known, and they bound the inner product of a query with anything in the cell: it is at most
q.c + |q| r, and, as the distance to a member is at least |q - c| - r, at most (|q|^2 + longest^2 - (|q - c| - r)^2) / 2.

A query first sees its best cells, as many as hold k rows. The k-th best score found there rules out every cell whose bound lies
below it; the query then sees the others, in blocks of queries and pool rows of which no pair is shuffled, and the k-th best score rises as it goes. A cell is cut into blocks of bounded size, so copies of one vector may fill any share of the
pool. Scores are summed in one fixed order, so equal vectors have equal scores wherever they lie.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from .blocks import PER_PART, Best, meet, meet_all, round_half_even, rows_per_block, slack
from .ranking import top_k

POOL_BLOCK = 8192
PIVOTS = 256
PER_PIVOT = 512
STEP = 256


def _matrix(rows: pd.Series) -> np.ndarray:
    return np.stack(rows.to_numpy()).astype(np.float64)


def _distance(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None, :] - 2 * (x @ pivots.T), 0.0))


def _cell(k: int, round_to: int | None, drop_self: bool):
    def run(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(p):
            p = p.sort_values("id")
            ids, x = p["id"].to_numpy(), _matrix(p["v"])
            longest = float(np.sqrt((x * x).sum(1).max()))
            for at in range(0, len(q), STEP):
                part = q.iloc[at : at + STEP]
                a = _matrix(part["v"])
                rough = a @ x.T
                near = 1e-12 * (1 + np.sqrt((a * a).sum(1)) * longest) + slack(round_to)
                if len(ids) > k + 1:  # one more than k: the query itself may be among them
                    least = -np.partition(-rough, k, axis=1)[:, k] - near
                else:
                    least = np.full(len(part), -np.inf)
                keep = rough >= np.maximum(least, part["bound"].to_numpy() - near)[:, None]
                for i, (query_id, bound) in enumerate(zip(part["id"], part["bound"])):
                    pick = np.flatnonzero(keep[i])
                    if drop_self:
                        pick = pick[ids[pick] != query_id]
                    score = round_half_even((x[pick] * a[i]).sum(axis=1), round_to)
                    best = np.argsort(-score, kind="stable")[:k]
                    out += [(query_id, ids[pick[j]], float(score[j])) for j in best if score[j] >= bound]
        return pd.DataFrame(out, columns=["query_id", "example_id", "score"])

    return run


def _vectors(table: pa.Table) -> np.ndarray:
    return table["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(table.num_rows, -1)


class _Seen:
    """A block of queries that sees the pool: cells that cannot reach the k-th best score so far are left out."""

    def __init__(self, rows: pa.Table, cells: Cells, k: int, round_to: int | None, drop_self: bool):
        self.a, self.cells, self.round_to, self.drop_self = _vectors(rows), cells, round_to, drop_self
        self.ids = rows["id"].to_pandas().to_numpy()
        self.best = Best(self.ids, rows["bound"].to_numpy(), k, [("id", True)])
        self.up, self.length = cells.bounds(self.a), np.sqrt((self.a * self.a).sum(1))

    def add(self, rows: pa.Table) -> None:
        k, loose = self.best.k, slack(self.round_to)
        cell = int(np.searchsorted(self.cells.first, rows["block"][0].as_py(), side="right")) - 1
        go = np.flatnonzero(self.up[:, cell] >= self.best.bound - loose)
        if not len(go):
            return
        rows = rows.sort_by("id")
        ids, x = rows["id"].to_pandas().to_numpy(), _vectors(rows)
        longest = float(np.sqrt((x * x).sum(1).max()))
        for at in range(0, len(go), STEP):
            part = go[at : at + STEP]
            rough, near = self.a[part] @ x.T, 1e-12 * (1 + self.length[part] * longest) + loose
            keep = rough >= (self.best.bound[part] - near)[:, None]
            many = np.flatnonzero(keep.sum(axis=1) > 4 * (k + 1))
            if len(many) and len(ids) > k + 1:  # one more than k: the query itself may be among them
                keep[many] &= rough[many] >= (-np.partition(-rough[many], k, axis=1)[:, k] - near[many])[:, None]
            for i in np.flatnonzero(keep.any(axis=1)):
                who, pick = part[i], np.flatnonzero(keep[i])
                if self.drop_self:
                    pick = pick[ids[pick] != self.ids[who]]
                score = round_half_even((x[pick] * self.a[who]).sum(axis=1), self.round_to)
                order = np.argsort(-score, kind="stable")[:k]
                order = order[score[order] >= self.best.bound[who]]
                if len(order):
                    self.best.add(int(who), {"example_id": ids[pick[order]], "score": score[order]})

    def rows(self) -> pd.DataFrame:
        return self.best.rows()


@dataclass
class Cells:
    """The pivots that have a cell, and of each cell its radius, longest vector, rows, blocks and first block."""

    points: np.ndarray
    r: np.ndarray
    long: np.ndarray
    n: np.ndarray
    blocks: np.ndarray
    first: np.ndarray

    def bounds(self, x: np.ndarray) -> np.ndarray:
        """The largest inner product each query can have in each cell, with room for rounding."""
        away, length = _distance(x, self.points), np.sqrt((x * x).sum(1))[:, None]
        straight = x @ self.points.T + length * self.r[None, :]
        gap = np.maximum(away - self.r[None, :], 0.0)
        bent = (length**2 + self.long[None, :] ** 2 - gap**2) / 2
        return np.minimum(np.minimum(straight, bent), length * self.long[None, :]) + 1e-9 * (1 + length * self.long[None, :])

    def home(self, up: np.ndarray, k: int) -> np.ndarray:
        """The cells of highest bound that together hold more than k rows."""
        order = np.argsort(-up, axis=1, kind="stable")
        before = np.cumsum(self.n[order], axis=1) - self.n[order]
        go = np.zeros(up.shape, bool)
        np.put_along_axis(go, order, before <= k, 1)
        return go

    def named(self, rows: pd.DataFrame, go: np.ndarray) -> pd.DataFrame:
        """Queries with the blocks of the cells they go to."""
        who, cell = np.nonzero(go)
        many = self.blocks[cell]
        block = np.repeat(self.first[cell], many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        return rows.iloc[np.repeat(who, many)].assign(block=block)


class VectorIndex:
    """A pool of vectors in cells around pivots, for several searches. ``pool`` has id and v; all vectors have one length."""

    def __init__(self, pool: DataFrame, pivots: int | None = None, block_rows: int = POOL_BLOCK):
        self.spark = spark = pool.sparkSession
        checkpoint_dir(spark)
        pool = pool.select("id", "v")
        self.kind = pool.schema["id"].dataType.simpleString()
        self.rows = pool.count()
        if not self.rows:
            return
        most = min(PIVOTS, 1 + self.rows // PER_PIVOT) if pivots is None else pivots
        points = [r["v"] for r in pool.orderBy(F.xxhash64("id")).limit(most).collect()]  # at most PIVOTS vectors
        points = np.array(points, np.float64)

        def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for rows in batches:
                if len(rows):
                    x = _matrix(rows["v"])
                    away = _distance(x, points)
                    cell = away.argmin(axis=1)
                    yield rows.assign(cell=cell, away=away[np.arange(len(rows)), cell], length=np.sqrt((x * x).sum(1)))

        vector = pool.schema["v"].dataType.simpleString()
        placed = pool.mapInPandas(place, f"id {self.kind}, v {vector}, cell long, away double, length double").checkpoint()
        per = rows_per_block(self.rows, spark.sparkContext.defaultParallelism, block_rows)
        stats = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("r"), F.max("length").alias("long")).orderBy("cell").collect()
        at = np.array([s["cell"] for s in stats])
        n, r, long = (np.array([s[c] for s in stats], float) for c in ("n", "r", "long"))
        blocks = np.maximum(1, np.ceil(n / per)).astype(int)
        first = np.concatenate([[0], np.cumsum(blocks)[:-1]])
        self.cells = Cells(points[at], r, long, n, blocks, first)
        table = spark.createDataFrame([(int(c), int(f), int(b)) for c, f, b in zip(at, first, blocks)], "cell long, first long, blocks long")
        held = placed.join(F.broadcast(table), "cell")  # a row per pivot
        self.held = held.select(F.col("id"), "v", (F.col("first") + F.pmod(F.xxhash64("id"), F.col("blocks"))).alias("block"))

    def nearest(self, queries: DataFrame, k: int, round_to: int | None = None, drop_self: bool = True) -> DataFrame:
        """(query_id, example_id, score, rank): the k best pool vectors of each query, exactly; ties to the smaller id."""
        schema = f"query_id {self.kind}, example_id {self.kind}, score double"
        if k <= 0 or not self.rows:
            return self.spark.createDataFrame([], schema + ", rank int")
        cells, loose = self.cells, slack(round_to)
        vector = queries.schema["v"].dataType.simpleString()

        def homes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for rows in batches:
                if len(rows):
                    go = cells.home(cells.bounds(_matrix(rows["v"])), k)
                    yield rows.assign(home=[np.flatnonzero(g).tolist() for g in go])

        def marked(rows: pd.DataFrame) -> np.ndarray:
            go = np.zeros((len(rows), len(cells.n)), bool)
            go[np.repeat(np.arange(len(rows)), [len(h) for h in rows["home"]]), np.concatenate(rows["home"].tolist()).astype(int)] = True
            return go

        def begin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for rows in batches:
                if len(rows):
                    yield cells.named(rows.drop(columns="home").assign(bound=-np.inf), marked(rows))

        def go_on(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for rows in batches:
                if len(rows):
                    can = cells.bounds(_matrix(rows["v"])) >= rows["bound"].to_numpy()[:, None] - loose
                    yield cells.named(rows[["id"]], can & ~marked(rows))

        asked = queries.select("id", "v").mapInPandas(homes, f"id {self.kind}, v {vector}, home array<long>").checkpoint()  # decided once: the second round leaves out just these
        row = f"id {self.kind}, v {vector}, bound double"
        see = lambda visits: meet(visits, self.held, _cell(k, round_to, drop_self), schema)
        order = [F.desc("score"), "example_id"]
        seen = see(asked.mapInPandas(begin, row + ", block long")).checkpoint()
        kth = top_k(seen, ["query_id"], order, k).where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("bound"))
        bounded = asked.join(kth, "id", "left").select("id", "v", "home", F.coalesce("bound", F.lit(float("-inf"))).alias("bound")).checkpoint()
        self.visits = bounded.mapInPandas(go_on, f"id {self.kind}, block long")  # what the bounds of the first round leave to see
        blocks = max(1, ceil(bounded.count() / PER_PART))
        dealt = bounded.select("id", "v", "bound", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("long").alias("block"))
        found = meet_all(dealt, self.held, lambda rows: _Seen(rows, cells, k, round_to, drop_self), schema)
        return top_k(found, ["query_id"], order, k)
