"""Scratch tables in the shared folder and the word and hash arrays several operators work on."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession) -> str:
    """A new path in the folder of ``spark.checkpoint.dir``. A local folder of its own only for a local master that sets none."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spanloom-", dir="/tmp")
    return f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """The rows, written to the shared folder and read back: computed once, lineage cut, size known to the planner."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sampled(df: DataFrame, key: str, n: int, rows: int) -> DataFrame:
    """About n of a table's rows, by a hash of their key; all of them where it has no more."""
    place = F.pmod(F.xxhash64(key), F.lit(1 << 32))
    return df.where(place * rows < F.lit(n << 32).cast("decimal(38,0)"))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: spreads every input bit over the whole word."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least n of each."""
    if not _POWERS or len(_POWERS["up"]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        _POWERS["up"] = _powers(_BASE, size)
        _POWERS["down"] = _powers(pow(_BASE, -1, 1 << 64), size)
    return _POWERS["up"], _POWERS["down"]


# Bytes of a word: digits, letters, everything outside ASCII; capitals count as small letters.
WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[0x30:0x3A] = True
WORD_BYTE[0x61:0x7B] = True
WORD_BYTE[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the words of one text with the places where they start and end."""
    raw = LOWER[np.frombuffer(data, np.uint8)]
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = WORD_BYTE[raw]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.empty(0, np.uint64), starts, ends
    up, down = powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=total[1:])
    h = (total[ends] - total[starts]) * down[starts]
    h ^= (ends - starts).astype(np.uint64) << np.uint64(57)
    return mix(h), starts, ends


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """One hash for each run of k words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    up, _ = powers(k + 1)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h += words[j : j + n] * up[j + 1]
    return mix(h)
