"""Documents packed into as few token sequences as a local search finds.

A document longer than a sequence is cut into full pieces and a rest; nothing else is cut. Pieces are dealt to shards by hash,
about ``PER_SHARD`` in each, and a shard is packed in one task: each piece, longest first, into the fullest sequence that takes
it, then a search over the underfull sequences. It takes the emptiest one and moves its pieces elsewhere, exchanges one of them
for one or two shorter ones, or two of them for one, each step raising the sum of squared fills, until the sequence is empty or
no step is left. The search ends when so many sequences in a row could not be emptied (``TRIES``).

The emptiest sequences of a shard, those that hold nearly all of its free room (``REST`` at most), are then taken apart again with
those of other shards, ``MERGED`` shards at a time, round after round until all have met. So a group holds a bounded number of pieces
whatever the number of shards, and the free room of many shards comes together in a few rounds.

NULL and empty texts hold the end id only. Repeated rows are pieces of their own. An empty table gives no rows. Other columns
are ignored. A sequence holds at most as many pieces as tokens, so no group grows with the data.
"""

from __future__ import annotations

import bisect
import heapq
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import stored
from .tokens import encoder

LENGTH = 2048
PER_SHARD = 25_000
MERGED = 8
REST = 256
TRIES = 16
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, end_id: int, length: int = LENGTH) -> DataFrame:
    """The pieces of every document with their checksums: ids, then the end id, cut at multiples of the sequence length."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = enc.encode(text.as_py()) + end
                for k, at in enumerate(range(0, len(ids), 4 * length)):
                    part = ids[at : at + 4 * length]
                    out.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()])], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(cut, PIECES)


def best_fit(lengths: np.ndarray, size: int) -> list[list[int]]:
    """Sequences as lists of places in ``lengths``. Free room is a set of bits, so the tightest fit is the lowest bit above a length."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(size + 1)]
    rooms = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fit = rooms >> n
        if fit:
            room = n + (fit & -fit).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
            bins[b].append(i)
        else:
            room, b = size, len(bins)
            bins.append([i])
        if room > n:
            by_room[room - n].append(b)
            rooms |= 1 << (room - n)
    return bins


class _Underfull:
    """The underfull sequences of a shard: their pieces by length, and the steps of the search."""

    def __init__(self, bins: list[list[int]], lengths: np.ndarray, size: int):
        self.bins, self.lengths, self.size = bins, lengths, size
        self.room = [size - int(sum(lengths[i] for i in b)) for b in bins]
        self.item = np.array([i for b in bins for i in b], np.int64)
        self.home = np.array([k for k, b in enumerate(bins) for _ in b], np.int64)
        self.at = {int(i): p for p, i in enumerate(self.item)}
        self.n = lengths[self.item].astype(np.int64)
        self.rooms = np.array(self.room, np.int64)

    def move(self, i: int, to: int) -> None:
        p = self.at[i]
        old = int(self.home[p])
        self.bins[old].remove(i)
        self.bins[to].append(i)
        self.home[p] = to
        n = int(self.n[p])
        self.rooms[old] += n
        self.rooms[to] -= n

    def _partner(self, give: int, own: int, less: int = 0) -> tuple[int, int] | None:
        """The piece elsewhere whose exchange for ``give`` tokens fills its sequence best: (piece, its sequence)."""
        gain = give - self.n
        ok = (gain > less) & (gain <= self.rooms[self.home]) & (self.home != own) & (self.rooms[self.home] < self.size)
        if not ok.any():
            return None
        p = int(np.argmax(np.where(ok, gain, -1)))
        return int(self.item[p]), int(self.home[p])

    def step(self, b: int) -> bool:
        """One improving step that takes tokens out of sequence b. The others are fuller, so each raises the sum of squares."""
        own = sorted(self.bins[b], key=lambda i: (-int(self.lengths[i]), i))
        open_ = self.rooms < self.size
        open_[b] = False
        for i in own:
            n = int(self.lengths[i])
            ok = open_ & (self.rooms >= n)
            if ok.any():
                self.move(i, int(np.argmin(np.where(ok, self.rooms, self.size + 1))))
                return True
        for i in own:
            found = self._partner(int(self.lengths[i]), b)
            if found:
                self.move(i, found[1])
                self.move(found[0], b)
                return True
        for k, i in enumerate(own):
            for j in own[k + 1 :]:
                found = self._partner(int(self.lengths[i] + self.lengths[j]), b)
                if found:
                    self.move(i, found[1])
                    self.move(j, found[1])
                    self.move(found[0], b)
                    return True
        for i in own:
            n = int(self.lengths[i])
            for other in np.flatnonzero(open_ & (self.rooms > 0)).tolist():
                pair = self._pair(other, n)
                if pair:
                    self.move(i, other)
                    for x in pair:
                        self.move(x, b)
                    return True
        return False

    def _pair(self, other: int, n: int) -> tuple[int, int] | None:
        """Two pieces of a sequence, together shorter than n by no more than its room; the shortest such pair."""
        items = sorted(self.bins[other], key=lambda i: (int(self.lengths[i]), i))
        sizes = [int(self.lengths[i]) for i in items]
        least = n - int(self.rooms[other])
        for k, a in enumerate(sizes):
            j = bisect.bisect_left(sizes, least - a, k + 1)
            if j < len(sizes) and a + sizes[j] < n:
                return items[k], items[j]
        return None


def improve(bins: list[list[int]], lengths: np.ndarray, size: int, tries: int = TRIES) -> list[list[int]]:
    """Empties underfull sequences, emptiest first, by steps that each raise the sum of squared fills."""
    fill = [int(sum(lengths[i] for i in b)) for b in bins]
    done = [b for b, f in zip(bins, fill) if f == size]
    search = _Underfull([list(b) for b, f in zip(bins, fill) if f < size], lengths, size)
    spare = size * len(search.bins) - int(search.n.sum())  # free room of all sequences together
    order = [(-int(r), k) for k, r in enumerate(search.rooms)]
    heapq.heapify(order)
    failed = 0
    while order and spare >= size and failed < tries:
        room, b = heapq.heappop(order)
        if not search.bins[b]:
            continue
        if -room != search.rooms[b]:  # filled up since
            heapq.heappush(order, (-int(search.rooms[b]), b))
            continue
        while search.bins[b] and search.step(b):
            pass
        if search.bins[b]:
            failed += 1
        else:
            failed, spare = 0, spare - size
    return done + [b for b in search.bins if b]


def emptiest(bins: list[list[int]], lengths: np.ndarray, size: int, most: int = REST) -> set[int]:
    """Places of the sequences that are packed once more: emptiest first, until what the others have free is less than half a sequence."""
    rooms = np.array([size - int(lengths[b].sum()) for b in bins], np.int64)
    order = np.argsort(-rooms, kind="stable")[: min(most, int((rooms > 0).sum()))]
    behind = rooms.sum() - np.cumsum(rooms[order])
    return set(order[: int((behind >= size // 2).sum()) + 1].tolist())


def packed(lengths: np.ndarray, size: int = LENGTH) -> list[list[int]]:
    return improve(best_fit(lengths, size), lengths, size)


def _group(size: int, keep_rest: bool):
    """Packs one group; without ``keep_rest`` all sequences are final, else the pieces of the emptiest ones come back without a number."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece", "start", "ids_crc32"], ascending=[False, True, True, True, True], ignore_index=True)
        lengths = rows["length"].to_numpy(np.int64)
        number, offset = np.full(len(rows), -1, np.int64), np.zeros(len(rows), np.int64)
        bins = packed(lengths, size)
        again = emptiest(bins, lengths, size) if keep_rest else set()
        for k, b in enumerate(bins):
            if k not in again:
                number[b] = k
                offset[b] = np.cumsum(lengths[b]) - lengths[b]
        return rows.assign(shard=key[0], number=number, offset=offset)

    return run


def pack(parts: DataFrame, size: int = LENGTH, per_shard: int = PER_SHARD) -> DataFrame:
    """Pieces with sequence_id and offset. ``parts`` should be stored: it is counted first."""
    groups = max(1, round(parts.count() / per_shard))
    placed = PIECES + ", shard long, number long, offset long"
    rows = parts.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups)))
    finished, level = [], 0
    while True:
        rows = stored(rows.groupBy("shard").applyInPandas(_group(size, groups > 1), placed))
        finished.append(rows.where("number >= 0").withColumn("sequence_id", (F.col("shard") * 64 + level) * (1 << 32) + F.col("number")))
        if groups == 1:
            break
        groups, level = -(-groups // MERGED), level + 1
        rows = rows.where("number < 0").drop("number", "offset").withColumn("shard", F.floor(F.col("shard") / MERGED))
    return reduce(DataFrame.unionByName, finished).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents cut and packed."""
    return packed_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def packed_documents(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return pack(stored(pieces(docs, public_tokenizers.path("word_bpe_49k.json"), 0)))


QUERIES = {"op10_packing": op10_packing}
