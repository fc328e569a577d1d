"""Columns of number arrays as matrices, and sums of small matrices over all tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(vector: str | Column) -> Column:
    """Whether an array is there and all its entries are numbers; false for NULL."""
    v = F.col(vector) if isinstance(vector, str) else vector
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.coalesce(~bad, F.lit(False))


def common_length(df: DataFrame, vector: str) -> int:
    """The length most arrays have, the smaller one at a tie; 0 without rows."""
    row = df.where(finite(vector)).groupBy(F.size(vector).alias("n_")).count().orderBy(F.desc("count"), "n_").first()
    return int(row["n_"]) if row else 0


def matrix(column: pa.Array, width: int, kind: type = np.float64) -> np.ndarray:
    """A list column whose lists all have one length, as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.ascontiguousarray(flat.reshape(len(column), width), dtype=kind)


def lists(values: np.ndarray) -> pa.ListArray:
    """The rows of a matrix as a list column."""
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(values.ravel()))


def summed(df: DataFrame, partial: Callable[[Iterator[pa.RecordBatch]], np.ndarray], kind: str = "double") -> dict[int, float | int]:
    """Entries of a small array that every task computes from its rows, added over all tasks: {place: sum}, without zeros.

    ``partial`` gives one array of the same size from each task. Whole numbers (kind long) are added exactly.
    """

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = partial(batches).ravel()
        at = np.flatnonzero(flat)
        if len(at):
            yield pa.record_batch([pa.array(at), pa.array(flat[at])], names=["at", "x"])

    parts = df.mapInArrow(entries, f"at long, x {kind}")
    total = F.sum(F.col("x").cast("decimal(38,0)") if kind == "long" else F.col("x"))
    turn = int if kind == "long" else float
    return {r["at"]: turn(r["x"]) for r in parts.groupBy("at").agg(total.alias("x")).collect()}
