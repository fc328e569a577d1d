"""Nearest neighbours by inner product over p-stable hash tables whose buckets are probed in estimated success order.

Vectors get one more component that gives all of them the length M of the longest, and a query is stretched to M, so the largest
inner product is the least distance. Each table cuts ``hashes`` Gaussian projections into ``slots`` strips of equal width, the outer
ones open, and a bucket is a combination of strips. A neighbour at distance r differs from the query by a normal deviate of spread r
in each projection, which gives the success probability of every strip and, multiplied, of every bucket. A query visits the buckets
of each table in falling order of that probability until their sum reaches the coverage and they hold enough rows for a full answer.

r and the coverage are fitted: the true neighbours of ``SAMPLE`` queries are found by brute force over all rows, and the coverage is
the least at which ``TARGET`` of them are found. Strip widths come from ``FIT`` rows. Every row is in every table.

Buckets are gathered into blocks of about ``BLOCK`` rows; a bucket with more is split by row over several blocks, all of which its
queries visit, so a bucket may hold any share of the rows. A block's queries are dealt to parts of about ``PART``, and each part
meets the block in one call, which keeps the k best of the buckets its query visits, by exact inner products in double precision.
Answers of all tables and blocks are merged by rank. No pair list is made.

A row is itself, not its id: rows of equal id are neighbours of each other and each a query. NULL ids are candidates, never queries,
and come last among ties. Vectors that are NULL, zero, of another length than most, or hold NULL or non-finite entries take no part.
Fewer candidates than k are all returned. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .dense import common_length, finite, matrix, summed
from .shared import sampled, stored

TABLES, SLOTS, STRIP = 2, 6, 0.8
ROWS_PER_BUCKET, MOST_BUCKETS = 256, 1 << 16
FIT, SAMPLE, TARGET = 4096, 256, 0.96
BLOCK, PART, STEP = 8192, 4096, 128
LAST = np.iinfo(np.int64).max


@dataclass
class Index:
    """What every task needs: projections, strips, the rows in each bucket, and how far to probe. Its size is bounded by parameters."""

    turn: np.ndarray  # (width + 1) x (tables * hashes)
    low: np.ndarray  # lower end of the second strip of each projection
    strip: np.ndarray
    tables: int
    hashes: int
    slots: int
    length: float
    filled: np.ndarray | None = None  # tables x buckets
    block: np.ndarray | None = None  # first block of each bucket
    parts: np.ndarray | None = None  # blocks of each bucket
    reach: float = 0.0
    coverage: float = 0.0

    def projected(self, x: np.ndarray, query: bool) -> np.ndarray:
        norm = np.sqrt((x * x).sum(axis=1))
        if query:
            return (x * (self.length / norm)[:, None]) @ self.turn[:-1]
        return x @ self.turn[:-1] + np.sqrt(np.maximum(self.length**2 - norm * norm, 0.0))[:, None] * self.turn[-1]

    def codes(self, x: np.ndarray) -> np.ndarray:
        """The bucket of each row in each table."""
        strips = np.clip(np.floor((self.projected(x, False) - self.low) / self.strip) + 1, 0, self.slots - 1).astype(np.int64)
        return strips.reshape(len(x), self.tables, self.hashes) @ (self.slots ** np.arange(self.hashes)[::-1])

    def order(self, x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Per table: buckets of each query in success order, and the success summed over those before."""
        f = self.projected(x, True)
        ends = self.low[:, None] + self.strip[:, None] * np.arange(self.slots - 1)
        erf = np.frompyfunc(math.erf, 1, 1)
        below = 0.5 + 0.5 * erf((ends[None] - f[:, :, None]) / (self.reach * math.sqrt(2))).astype(float)
        edge = np.ones((*f.shape, 1))
        share = np.diff(np.concatenate([0 * edge, below, edge], axis=2)).reshape(len(x), self.tables, self.hashes, self.slots)
        for t in range(self.tables):
            p = np.ones((len(x), 1))
            for h in range(self.hashes):
                p = (p[:, :, None] * share[:, t, h, None, :]).reshape(len(x), -1)
            order = np.argsort(-p, axis=1, kind="stable")
            p = np.take_along_axis(p, order, 1)
            yield order, np.cumsum(p, axis=1) - p

    def visited(self, x: np.ndarray, k: int) -> Iterator[tuple[int, int, np.ndarray]]:
        """(query, table, its buckets that hold rows), until the coverage is reached and more than k rows are met."""
        for t, (order, before) in enumerate(self.order(x)):
            held = self.filled[t][order]
            go = ((before < self.coverage) | (np.cumsum(held, axis=1) - held <= k)) & (held > 0)
            for i in range(len(x)):
                yield i, t, order[i, go[i]]


def usable(df: DataFrame, key: str, vector: str, width: int, every: int) -> DataFrame:
    """row, id, v and whether the row is a query, for all vectors that take part."""
    v = F.col(f"`{vector}`")
    some = F.exists(v, lambda x: x != 0)
    rows = df.where((F.size(v) == width) & finite(v)).where(some)
    key_ = F.col(f"`{key}`").cast("long")
    return rows.select(F.monotonically_increasing_id().alias("row"), key_.alias("id"), v.alias("v"), F.coalesce(key_ % every == 0, F.lit(False)).alias("query"))


def _read(batch: pa.RecordBatch | pa.Table, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, ids (NULL as the largest) and vectors of a batch."""
    flat = lambda name: batch.column(name).combine_chunks() if isinstance(batch, pa.Table) else batch.column(name)
    return flat("row").to_numpy(zero_copy_only=False), flat("id").fill_null(LAST).to_numpy(zero_copy_only=False), matrix(flat("v"), width)


def best(q: np.ndarray, own: np.ndarray, x: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int, seen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, place in x, score) of the k best of each query, ties to the smaller id. ``seen`` marks the pairs that count.

    A matrix product finds the candidates; their scores are sums in one fixed order, so a pair has the same score wherever it is met.
    """
    rough = q @ x.T
    rough[own[:, None] == rows[None, :]] = -np.inf
    if seen is not None:
        rough[~seen] = -np.inf
    if rough.shape[1] > k:
        least = -np.partition(-rough, k - 1, axis=1)[:, k - 1]
        least = least - 1e-12 * np.sqrt((q * q).sum(axis=1)) * np.sqrt((x * x).sum(axis=1).max())
    else:
        least = np.full(len(q), -np.inf)
    i, j = np.nonzero((rough >= least[:, None]) & (rough > -np.inf))
    score = np.empty(len(i))
    for at in range(0, len(i), 1 << 16):
        s = slice(at, at + (1 << 16))
        score[s] = (q[i[s]] * x[j[s]]).sum(axis=1)
    order = np.lexsort((rows[j], ids[j], -score, i))
    i, j, score = i[order], j[order], score[order]
    rank = np.arange(len(i)) - np.searchsorted(i, i)
    return i[rank < k], j[rank < k], score[rank < k]


def _answers(i: np.ndarray, own: np.ndarray, columns: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """One row per query with its candidates as lists."""
    if len(i):
        who, start = np.unique(i, return_index=True)
        offsets = pa.array(np.append(start, len(i)).astype(np.int32))
        yield pa.record_batch([pa.array(own[who]), *[pa.ListArray.from_arrays(offsets, pa.array(c)) for c in columns.values()]], names=["asker", *columns])


def fit(vectors: DataFrame, width: int, rows: int, hashes: int | None) -> Index:
    """Projections and strips, and how the rows fill the buckets."""
    longest = vectors.select(F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))))).first()[0]
    if hashes is None:
        hashes = max(2, min(round(math.log(max(rows / ROWS_PER_BUCKET, 1), SLOTS)) + 1, int(math.log(MOST_BUCKETS, SLOTS))))
    rng = np.random.default_rng(12)
    turn = rng.standard_normal((width + 1, TABLES * hashes))
    index = Index(turn, np.zeros(0), np.zeros(0), TABLES, hashes, SLOTS, float(longest))
    some = np.array([r["v"] for r in sampled(vectors.select("row", "v"), "row", FIT, rows).limit(2 * FIT).collect()] or [[1.0] * width], float)
    p = index.projected(some, False)
    index.strip = np.maximum(p.std(axis=0) * STRIP, 1e-9 * longest)
    index.low = np.median(p, axis=0) + index.strip * (rng.random(TABLES * hashes) - 0.5 - (SLOTS - 2) / 2)
    buckets = SLOTS**hashes
    first = np.arange(TABLES) * buckets

    def count(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        out = np.zeros(TABLES * buckets, np.int64)
        for batch in batches:
            out += np.bincount((index.codes(matrix(batch.column("v"), width)) + first).ravel(), minlength=len(out))
        return out

    found = summed(vectors.select("v"), count, "long")
    index.filled = np.array([found.get(j, 0) for j in range(TABLES * buckets)], np.int64).reshape(TABLES, buckets)
    index.parts = np.maximum(1, -(-index.filled // BLOCK))
    index.block = np.zeros_like(index.filled)
    number = 0
    for t in range(TABLES):
        room = 0
        for c in np.flatnonzero(index.filled[t]).tolist():
            n, many = int(index.filled[t, c]), int(index.parts[t, c])
            if many > 1 or n > room:
                index.block[t, c], number, room = number, number + many, 0 if many > 1 else BLOCK - n
            else:
                index.block[t, c], room = number - 1, room - n
    return index


def exact(vectors: DataFrame, askers: list, width: int, k: int) -> DataFrame:
    """asker, row, id, score of the k nearest of a bounded list of queries, by brute force over all rows."""
    q, own = np.array([r["v"] for r in askers], float), np.array([r["row"] for r in askers], np.int64)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                rows, ids, x = _read(batch.slice(at, BLOCK), width)
                i, j, s = best(q, own, x, rows, ids, k)
                yield from _answers(i, own, {"row": rows[j], "id": ids[j], "score": s})

    return _merged(vectors.mapInArrow(score, "asker long, row array<long>, id array<long>, score array<double>"), k)


def _merged(answers: DataFrame, k: int) -> DataFrame:
    """asker, row, id, score, rank of the k best over all blocks and tables; the planner cuts to k per task before the shuffle."""
    each = answers.select("asker", F.inline(F.arrays_zip("row", "id", "score")))
    rank = F.dense_rank().over(W.partitionBy("asker").orderBy(F.desc("score"), "id", "row"))
    return each.withColumn("rank", rank).where(F.col("rank") <= k).distinct()


def calibrate(vectors: DataFrame, index: Index, width: int, k: int) -> float:
    """Sets reach and coverage from the true neighbours of a sample of queries; gives the share of them that the index finds."""
    queries = vectors.where("query").select("row", "v")
    askers = sampled(queries, "row", SAMPLE, queries.count()).limit(2 * SAMPLE).collect()
    index.reach, index.coverage = float(index.length), 1.0
    if not askers:
        return 1.0
    truth = stored(exact(vectors, askers, width, k))
    pairs = truth.join(vectors.select("row", "v"), "row").select("asker", "v").collect()  # SAMPLE x k rows
    if not pairs:
        return 1.0
    at = {r["row"]: n for n, r in enumerate(askers)}
    q, x, who = np.array([r["v"] for r in askers], float), np.array([r["v"] for r in pairs], float), np.array([at[r["asker"]] for r in pairs])
    unit = q / np.sqrt((q * q).sum(axis=1))[:, None]
    apart = np.maximum(2 * index.length**2 - 2 * index.length * (unit[who] * x).sum(axis=1), 0.0)
    index.reach = max(float(np.sqrt(apart.mean())), 1e-9 * index.length)
    codes, need = index.codes(x), np.full(len(x), np.inf)
    for t, (order, before) in enumerate(index.order(q)):
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.broadcast_to(np.arange(order.shape[1]), order.shape), 1)
        need = np.minimum(need, before[who, place[who, codes[:, t]]])
    index.coverage = float(np.nextafter(np.quantile(need, TARGET, method="higher"), 2.0))
    return float((need < index.coverage).mean())


def search(df: DataFrame, key: str, vector: str, k: int, every: int, hashes: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found of every row whose key is divisible by ``every``."""
    width = common_length(df, f"`{vector}`")
    vectors = stored(usable(df, key, vector, width, every))
    rows = vectors.count()
    if not rows:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    index = fit(vectors, width, rows, hashes)
    calibrate(vectors, index, width, k)
    state = asdict(index)  # plain arrays travel in a broadcast; the class travels with the functions
    sent = df.sparkSession.sparkContext.broadcast(state)
    kind = vectors.schema["v"].dataType.simpleString()

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each row to its block in each table."""
        own = Index(**sent.value)
        for batch in batches:
            n, codes = batch.num_rows, own.codes(matrix(batch.column("v"), width))
            row = batch.column("row").to_numpy()
            for t in range(own.tables):
                block = own.block[t][codes[:, t]] + row % own.parts[t][codes[:, t]]
                yield pa.record_batch([pa.array(block), pa.array(codes[:, t].astype(np.int32)), batch.column("row"), batch.column("id"), batch.column("v")], names=["block", "bucket", "row", "id", "v"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query to every block that holds a bucket it visits, with those buckets."""
        own = Index(**sent.value)
        for whole in batches:
            for at in range(0, whole.num_rows, STEP):
                batch = whole.slice(at, STEP)
                take, blocks, buckets = [], [], []
                for i, t, visit in own.visited(matrix(batch.column("v"), width), k):
                    first, parts = own.block[t][visit], own.parts[t][visit]
                    for b in np.unique(first).tolist():
                        inside = visit[first == b].astype(np.int32)
                        for p in range(int(parts[first == b].max())):
                            take.append(i)
                            blocks.append(b + p)
                            buckets.append(inside)
                part = batch.take(pa.array(take, pa.int64()))
                yield pa.record_batch([pa.array(blocks, pa.int64()), pa.array(buckets, pa.list_(pa.int32())), part.column("row"), part.column("v")], names=["block", "buckets", "row", "v"])

    dealt = vectors.select("row", "id", "v").mapInArrow(deal, f"block long, bucket int, row long, id long, v {kind}")
    asked = stored(vectors.where("query").select("row", "v").mapInArrow(probe, f"block long, buckets array<int>, row long, v {kind}"))
    parts = asked.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / PART).alias("parts"))
    left = asked.join(parts, "block").withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts"))).drop("parts")
    right = dealt.join(parts, "block").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")

    def meet(asking: pa.Table, held: pa.Table) -> pa.Table:
        out = []
        if asking.num_rows and held.num_rows:
            rows, ids, x = _read(held, width)
            bucket = held.column("bucket").to_numpy()
            names, home = np.unique(bucket, return_inverse=True)
            own_all, q_all = asking.column("row").to_numpy(), matrix(asking.column("v").combine_chunks(), width)
            lists = asking.column("buckets").combine_chunks()
            for at in range(0, asking.num_rows, STEP):
                part = lists.slice(at, STEP)
                visit = np.zeros((len(part), len(names)), bool)
                flat, who = part.flatten().to_numpy(), np.repeat(np.arange(len(part)), part.value_lengths().to_numpy())
                place = np.searchsorted(names, flat)
                known = (place < len(names)) & (names[np.minimum(place, len(names) - 1)] == flat)
                visit[who[known], place[known]] = True
                i, j, s = best(q_all[at : at + STEP], own_all[at : at + STEP], x, rows, ids, k, visit[:, home])
                out.extend(_answers(i, own_all[at : at + STEP], {"row": rows[j], "id": ids[j], "score": s}))
        return pa.Table.from_batches(out, schema=pa.schema([("asker", pa.int64()), *[(n, pa.list_(t)) for n, t in (("row", pa.int64()), ("id", pa.int64()), ("score", pa.float64()))]]))

    met = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(meet, "asker long, row array<long>, id array<long>, score array<double>")
    names = vectors.where("query").select(F.col("row").alias("asker"), F.col("id").alias("query_id"))
    out = _merged(met, k).join(names, "asker")
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), F.nullif("id", F.lit(int(LAST))).alias("vec_id"), "score")


def op12_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every embedding whose id is divisible by 20."""
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding", 20, 20)


QUERIES = {"op12_nearest_neighbours": op12_nearest_neighbours}
