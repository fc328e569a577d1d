"""Hashed text vectors by MD5, which SQL can state too."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.core import collapse
from ..functions.vectors import CHAR_WEIGHT, DIMENSIONS, PART, WORD_WEIGHT, digest_buckets

_WORD = re.compile(r"[a-z0-9_]+|[一-鿿]")
TEXTS = 256  # texts that are counted at once


def hashed_buckets(texts: DataFrame, key: str, dimensions: int = DIMENSIONS, packed: bool = False) -> DataFrame:
    """(key, bucket, words, chars): signed feature counts per bucket, bucket and sign from an MD5 digest.

    Texts are spread and sorted by key, so the texts of a key follow each other and are added up where they are counted: buckets are not
    shuffled. With ``packed`` there is one row per key with ``buckets``, in order of their number. A worker takes few texts at a time, and a
    feature is digested once per worker, not at every place it occurs.
    """
    low = F.concat(F.lit(" "), collapse(F.lower("text")), F.lit(" "))
    rows = texts.select(key, "text").repartition(key).where("text IS NOT NULL").select(key, low.alias("packed")).sortWithinPartitions(key)
    bucket = T.StructType([T.StructField(c, T.LongType()) for c in ("bucket", "words", "chars")])
    schema = T.StructType([texts.schema[key], T.StructField("buckets", T.ArrayType(bucket))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: tuple[dict[str, int], dict[str, int]] = ({}, {})
        open_ = None  # a key whose texts may go on, with its cells

        def out(keys: list, kind: pa.DataType, group: np.ndarray, cells: list[np.ndarray]) -> pa.RecordBatch:
            ends = np.searchsorted(group, np.arange(len(keys) + 1))
            some = np.flatnonzero(np.diff(ends))  # keys without features go
            lists = pa.ListArray.from_arrays(pa.array(np.append(ends[some], ends[-1]), pa.int32()), pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in cells], names=["bucket", "words", "chars"]))
            return pa.record_batch([pa.array([keys[i] for i in some], kind), lists], names=[key, "buckets"])

        for batch in batches:
            kind, at = batch.column(0).type, 0
            while at < batch.num_rows:
                names, part, size = [], [], 0
                while at < batch.num_rows and len(part) < TEXTS and size <= PART:
                    names.append(batch.column(0)[at].as_py())
                    part.append(batch.column(1)[at].as_py())
                    size, at = size + len(part[-1]), at + 1
                owner, *found = digest_buckets([(_WORD.findall(t), t) for t in part], known, dimensions)
                # Neighbours of one key are one group; the first goes on with the open key or closes it.
                keys, group = ([], []) if open_ is None else ([open_[0]], [])
                for name in names:
                    if not keys or keys[-1] != name:
                        keys.append(name)
                    group.append(len(keys) - 1)
                cell = np.array(group, np.int64)[owner] * dimensions + found[0]
                values = found[1:]
                if open_ is not None:
                    cell, values = np.concatenate([open_[1], cell]), [np.concatenate(v) for v in zip(open_[2], values)]
                cell, which = np.unique(cell, return_inverse=True)
                values = [np.bincount(which, weights=v, minlength=len(cell)).astype(np.int64) for v in values]
                last = int(np.searchsorted(cell, (len(keys) - 1) * dimensions))
                open_ = (keys[-1], cell[last:] - (len(keys) - 1) * dimensions, [v[last:] for v in values])
                if last:
                    yield out(keys[:-1], kind, cell[:last] // dimensions, [cell[:last] % dimensions, *[v[:last] for v in values]])
        if open_ is not None and len(open_[1]):
            yield out([open_[0]], kind, open_[1] // dimensions, [open_[1], *open_[2]])

    counted = rows.mapInArrow(run, schema)
    return counted if packed else counted.select(key, F.inline("buckets"))


def bucket_weight():
    """Weight of a bucket row before normalisation."""
    return F.col("words") * WORD_WEIGHT + F.col("chars") * CHAR_WEIGHT


def hashed_vectors(texts: DataFrame, key: str, dimensions: int = DIMENSIONS) -> DataFrame:
    """(key, v): dense unit vectors; a text without features gets zeros."""
    b = hashed_buckets(texts, key, dimensions).select(key, "bucket", bucket_weight().alias("w"))
    packed = b.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("bucket", "w"))).alias("m"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("n"))
    slots = F.sequence(F.lit(0).cast("long"), F.lit(dimensions - 1).cast("long"))
    v = F.transform(slots, lambda i: F.coalesce(F.try_element_at("m", i) / F.col("n"), F.lit(0.0)))
    return texts.select(key).join(packed, key, "left").select(key, F.coalesce(v, F.array_repeat(F.lit(0.0), dimensions)).alias("v"))
