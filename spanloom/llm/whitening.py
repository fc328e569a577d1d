"""Embeddings turned to uncorrelated components of unit variance, from singular values of the centred rows.

Entries become whole numbers floor(scale * c) + shift, so sums are exact and a centred row is (n x - S) / n with one rounding. Each
task reduces its centred rows block by block to a triangular matrix by QR; the triangles are merged 64 at a time until one is left.
Householder reflections make it bidiagonal, dqds finds its singular values to high relative accuracy, and twisted factorisations give
the directions (``bidiagonal``). The covariance itself is never formed, which would square the condition of the rows.

The fit uses all vectors that take part: those that are not NULL, have the length most vectors have and hold finite entries only.
Repeated rows count each and are returned each; NULL ids keep their vector. Directions without variance cannot be whitened and give
no component, so there may be fewer than ``most``; a table of one row, of equal rows or without rows gives no rows. Other columns are
ignored. Nothing that grows with the rows reaches the driver: it gets sums, one triangle and, for the error, one small matrix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bidiagonal import directions
from .dense import common_length, finite, lists, matrix, summed
from .shared import stored

SCALE = 64
SHIFT = 1_000_000
MOST = 32
BLOCK = 4096
MERGED = 64


def whole(df: DataFrame, key: str, vector: str, width: int) -> DataFrame:
    """id and whole-number entries of the vectors that take part."""
    entries = F.transform(F.col(f"`{vector}`"), lambda c: F.floor(c.cast("double") * SCALE) + F.lit(SHIFT))
    return df.where((F.size(f"`{vector}`") == width) & finite(F.col(f"`{vector}`"))).select(F.col(f"`{key}`").alias("id"), entries.alias("v"))


def sums(vectors: DataFrame, width: int) -> tuple[int, list[int]]:
    """Number of rows and the exact sum of each entry."""

    def partial(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros(width + 1, np.int64)
        for batch in batches:
            total[:width] += matrix(batch.column("v"), width, np.int64).sum(axis=0)
            total[width] += batch.num_rows
        return total

    found = summed(vectors, partial, "long")
    return found.get(width, 0), [found.get(j, 0) for j in range(width)]


def scaled(rows: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """n x - S, exactly: in 64 bits where they suffice, else in Python's integers."""
    reach = max(int(rows.max(initial=0)), -int(rows.min(initial=0))) * n + max(map(abs, total))
    if reach < 1 << 62:
        return n * rows - np.array(total, np.int64)
    return n * rows.astype(object) - np.array(total, object)


def _triangle(rows: np.ndarray, upper: np.ndarray | None) -> np.ndarray:
    return np.linalg.qr(rows if upper is None else np.vstack([upper, rows]), mode="r")


def triangle(vectors: DataFrame, n: int, total: list[int]) -> np.ndarray:
    """R of the QR factorisation of all centred rows, square."""
    width = len(total)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        upper = None
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                rows = scaled(matrix(batch.column("v").slice(at, BLOCK), width, np.int64), n, total)
                upper = _triangle(rows.astype(float) / n, upper)
        if upper is not None:
            part = TaskContext.get().partitionId()
            yield pa.record_batch([pa.array([part], pa.int64()), pa.array([upper.ravel()], pa.list_(pa.float64()))], names=["part", "r"])

    def merge(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        upper = None
        for r in parts.sort_values("part")["r"]:
            upper = _triangle(np.reshape(r, (-1, width)), upper)
        return pd.DataFrame({"part": [key[0]], "r": [upper.ravel()]})

    parts = stored(vectors.mapInArrow(reduce, "part long, r array<double>"))
    while parts.count() > 1:
        parts = stored(parts.groupBy(F.floor(F.col("part") / MERGED).alias("to")).applyInPandas(merge, "part long, r array<double>"))
    rows = parts.collect()
    square = np.zeros((width, width))
    for r in rows:
        upper = np.reshape(r["r"], (-1, width))
        square[: len(upper)] = upper
    return square


def project(vectors: DataFrame, n: int, total: list[int], turn: np.ndarray) -> DataFrame:
    """id, exact deviation and the whitened entries of every vector."""
    width = len(total)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                rows = scaled(matrix(part.column("v"), width, np.int64), n, total)
                far = int(abs(rows).max())
                exact = rows if far * far * width < 1 << 62 else rows.astype(object)
                deviation = pa.array([str(d) for d in (exact * exact).sum(axis=1).tolist()])
                yield pa.record_batch([part.column("id"), deviation, lists((rows.astype(float) / n) @ turn)], names=["id", "deviation", "w"])

    kind = vectors.schema["id"].dataType.simpleString()
    out = vectors.mapInArrow(apply, f"id {kind}, deviation string, w array<double>")
    return out.withColumn("deviation", F.col("deviation").cast("decimal(38,0)"))


def identity_error(placed: DataFrame, n: int, width: int) -> float:
    """Largest entry of the covariance of whitened rows minus the identity; their means are taken first."""

    def total(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        out = np.zeros(width)
        for batch in batches:
            out += matrix(batch.column("w"), width).sum(axis=0)
        return out

    found = summed(placed.select("w"), total)
    mean = np.array([found.get(j, 0.0) for j in range(width)]) / n

    def products(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        out = np.zeros((width, width))
        for batch in batches:
            rows = matrix(batch.column("w"), width) - mean
            out += rows.T @ rows
        return out

    found = summed(placed.select("w"), products)
    covariance = np.array([found.get(j, 0.0) for j in range(width * width)]).reshape(width, width) / n
    return float(np.abs(covariance - np.eye(width)).max())


def whitened(df: DataFrame, key: str, vector: str, most: int = MOST) -> DataFrame:
    """One row per vector and component: key, component, n, deviation (decimal), whitened, explained, identity_error."""
    spark = df.sparkSession
    width = common_length(df, f"`{vector}`")
    vectors = stored(whole(df, key, vector, width))
    n, total = sums(vectors, width) if width else (0, [])
    e, turn, trace = directions(triangle(vectors, n, total), most) if n else (np.empty(0), None, 0.0)
    kind = vectors.schema["id"].dataType.simpleString()
    if not len(e):
        return spark.createDataFrame([], f"`{key}` {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
    placed = stored(project(vectors, n, total, turn * (np.sqrt(n) / np.sqrt(e))))
    error = identity_error(placed, n, len(e))
    shares = F.array(*[F.lit(float(x)) for x in e / trace])
    rows = placed.select("id", "deviation", F.posexplode("w").alias("k", "whitened"))
    return rows.select(
        F.col("id").alias(key), (F.col("k") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation",
        "whitened", F.get(shares, F.col("k")).alias("explained"), F.lit(error).alias("identity_error"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings, whitened. The contract asks for a deviation in long; one that does not fit is an error, never a wrong number."""
    return whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding").withColumn("deviation", F.col("deviation").cast("long"))


QUERIES = {"op13_embedding_whitening": op13_embedding_whitening}
