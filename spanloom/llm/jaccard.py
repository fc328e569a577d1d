"""Join of texts whose word shingles overlap by a Jaccard similarity of 0.8 or more, over a MinHash LSH forest.

Every text has a signature of ``FULL`` values in each tree of the forest; a node of a tree is a prefix of signatures, and texts below a
node meet in it. Matching starts at whole signatures and shortens the prefix one value at a time, which joins neighbouring nodes, until
the target recall is reached in two ways: by the probability that a pair at the threshold meets in some tree, and as measured on
real pairs. For the latter ``SAMPLE`` texts are compared exactly with all texts in the pass that makes the signatures, and of every
pair that reaches the threshold the longest prefix shared in any tree is kept; only their counts leave the tasks. Shorter prefixes contain
the matches of longer ones, so the groups are formed once, at the length reached. Groups only say who is compared: similarity is
then counted on the whole shingle sets.

Texts of equal words are one class and go on as one. Classes that meet in some group form neighbourhoods (components of the
group stars, found by joins). A neighbourhood is compared in blocks of bounded count and bytes: each pair of blocks is one group
of work that returns, for each class, its number of linked documents and one pair that ties it to the least class that it reaches
over them. So no list of all pairs is ever written, and a block pair holds only classes of one neighbourhood.

Words are runs of digits, letters and characters outside ASCII, without case for A-Z; a text of fewer than five words is one
shingle. NULL, empty and wordless texts are linked to nothing. Rows without doc_id are linked to nothing and have no class. Repeated
rows are copies of each other. Rows of one doc_id with different texts are compared as two texts under that id. Other columns are
ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .shared import gram_hashes, mix, sampled, stored, word_hashes

SHINGLE = 5
THRESHOLD = (4, 5)
TREES, FULL, RECALL = 32, 12, 0.999
SAMPLE = 256
BLOCK, BLOCK_SHINGLES = 512, 1 << 20


def matched_prefix(trees: int = TREES, full: int = FULL, threshold: tuple[int, int] = THRESHOLD, recall: float = RECALL) -> int:
    """The longest prefix at which a pair at the threshold still meets in some tree with the target probability."""
    s, length = threshold[0] / threshold[1], full
    while length > 1 and 1 - (1 - s**length) ** trees < recall:
        length -= 1
    return length


def shingles(data: bytes) -> tuple[np.ndarray, bytes | None]:
    """The sorted set of shingle hashes of a text and a digest of its words."""
    words, starts, ends = word_hashes(data)
    if not len(words):
        return np.empty(0, np.uint64), None
    return np.unique(gram_hashes(words, min(SHINGLE, len(words)))), hashlib.md5(words.tobytes()).digest()


def signature(grams: np.ndarray, factors: np.ndarray, offsets: np.ndarray, trees: int) -> np.ndarray:
    """A row of 16-bit values for each tree, from least hashes."""
    x = (grams >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(factors), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 2048):
        h = factors[:, None] * x[None, at : at + 2048]
        h += offsets[:, None]
        np.minimum(least, h.min(axis=1), out=least)
    return (mix(least.astype(np.uint64) + np.uint64(1)) & np.uint64(0xFFFF)).astype(np.uint16).reshape(trees, -1)


def _text_bytes(value) -> bytes:
    text = value.as_py()
    return text.encode() if text else b""


class Sampled:
    """Shingles and signatures of sampled texts, to find their exact neighbours among all texts."""

    def __init__(self, texts: list[bytes], sign):
        sets = {}
        for text in texts:
            grams, key = shingles(text)
            if key:
                sets[key] = grams
        self.keys = list(sets)
        self.sizes = np.array([len(g) for g in sets.values()], np.int64)
        self.signs = np.array([sign(g) for g in sets.values()])
        flat = np.concatenate(list(sets.values())) if sets else np.empty(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.grams, self.owner = flat[order], np.repeat(np.arange(len(sets)), self.sizes)[order] if sets else np.empty(0, np.int64)

    def levels(self, grams: np.ndarray, key: bytes, sign: np.ndarray, threshold: tuple[int, int]) -> list[int]:
        """For each sampled text of other words that is as similar as the threshold: the longest prefix shared in any tree."""
        low, high = np.searchsorted(self.grams, grams, "left"), np.searchsorted(self.grams, grams, "right")
        many = high - low
        if not many.any():
            return []
        at = np.repeat(low - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
        shared = np.bincount(self.owner[at], minlength=len(self.keys))
        num, den = threshold
        near = [k for k in np.flatnonzero(shared * (num + den) >= num * (self.sizes + len(grams))) if self.keys[k] != key]
        return [int(np.logical_and.accumulate(self.signs[k] == sign, axis=1).sum(axis=1).max()) for k in near]


def signed(docs: DataFrame, trees: int = TREES, full: int = FULL, threshold: tuple[int, int] = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """doc_id, digest of the words, number of shingles, the signature in each tree, and the prefixes shared with sampled neighbours."""
    rng = np.random.default_rng(20240601)
    factors = rng.integers(0, 1 << 32, trees * full, dtype=np.uint32) | np.uint32(1)
    offsets = rng.integers(0, 1 << 32, trees * full, dtype=np.uint32)
    some = sampled(docs.where("doc_id IS NOT NULL").select("doc_id", "text"), "doc_id", sample, docs.count()).collect() if sample else []
    texts = sorted({(r["text"] or "").encode() for r in some})
    known = Sampled(texts, lambda g: signature(g, factors, offsets, trees))
    parts = (known.keys, known.sizes, known.signs, known.grams, known.owner)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = Sampled([], None)
        near.keys, near.sizes, near.signs, near.grams, near.owner = parts
        for batch in batches:
            keys, counts, signs, levels = [], [], [], []
            for value in batch.column(1):
                grams, key = shingles(_text_bytes(value))
                sign = signature(grams, factors, offsets, trees) if key else None
                keys.append(key)
                counts.append(len(grams))
                signs.append([row.astype("<u2").tobytes() for row in sign] if key else None)
                levels.append(near.levels(grams, key, sign, threshold) if key else [])
            yield pa.record_batch([batch.column(0), pa.array(keys, pa.binary()), pa.array(counts, pa.int32()), pa.array(signs, pa.list_(pa.binary())), pa.array(levels, pa.list_(pa.int32()))],
                                  names=["doc_id", "key", "n", "trees", "levels"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, key binary, n int, trees array<binary>, levels array<int>")


def shared_prefixes(rows: DataFrame) -> dict[int, int]:
    """How many of the sampled pairs share a longest prefix of each length; a row per length."""
    return {r["level"]: r["count"] for r in rows.select(F.explode("levels").alias("level")).groupBy("level").count().collect()}


def recall_at(length: int, shared: dict[int, int]) -> float:
    """Share of the sampled pairs that meet at a prefix length; 1 where there are none."""
    total = sum(shared.values())
    return sum(n for level, n in shared.items() if level >= length) / total if total else 1.0


def reached(shared: dict[int, int], trees: int = TREES, full: int = FULL, threshold: tuple[int, int] = THRESHOLD, recall: float = RECALL) -> int:
    """The prefix length at which shortening ends: the model's, or less where real pairs ask for it."""
    length = matched_prefix(trees, full, threshold, recall)
    while length > 1 and recall_at(length, shared) < recall:
        length -= 1
    return length


def _nodes(length: int) -> Column:
    """For each tree the node at a depth: a hash of the tree and the first values of the signature."""
    return F.transform("trees", lambda x, t: F.xxhash64(t, F.substring(x, 1, 2 * length)))


def _with_shingles(rows: DataFrame) -> DataFrame:
    """Replaces the text of each class by its shingle set; rows whose words are not those of the class go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets, keep = [], []
            for value, key in zip(batch.column("text"), batch.column("key")):
                grams, own = shingles(_text_bytes(value))
                keep.append(own is not None and own == key.as_py())
                sets.append(grams.tobytes() if keep[-1] else None)
            out = batch.drop_columns(["text"]).append_column("grams", pa.array(sets, pa.binary()))
            yield out.filter(pa.array(keep, pa.bool_()))

    return rows.mapInArrow(run, "rep long, key binary, size long, bands array<long>, root long, blocks int, block int, grams binary")


def _meeting(bands: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``left`` and ``right`` of the classes that share a prefix in some tree."""
    same = np.zeros((len(left), len(right)), bool)
    for t in range(bands.shape[1]):
        same |= bands[left, t][:, None] == bands[right, t][None, :]
    return np.nonzero(same)


def _common(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the given pairs of sets."""
    if len(a) > 4 * len(sets):
        values, place = np.unique(np.concatenate(sets), return_inverse=True)
        times = np.bincount(place, minlength=len(values))
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        shared = times[place] > 1
        column = (np.cumsum(times > 1) - 1)[place[shared]]
        owner = owner[shared]
        width = int(column.max()) + 1 if len(column) else 0
        pair_cost, table_cost = len(a) * np.mean([len(s) for s in sets]) * 20, width * len(sets) ** 2 / 8
        if table_cost < pair_cost:
            order = np.argsort(column, kind="stable")
            column, owner = column[order], owner[order]
            counts = np.zeros((len(sets), len(sets)), np.float32)
            for at in range(0, width, 4096):
                lo, hi = np.searchsorted(column, (at, at + 4096))
                table = np.zeros((len(sets), min(4096, width - at)), np.float32)
                table[owner[lo:hi], column[lo:hi] - at] = 1
                counts += table @ table.T
            return counts[a, b].astype(np.int64)
    out = np.empty(len(a), np.int64)
    for k, (i, j) in enumerate(zip(a.tolist(), b.tolist())):
        x, y = (sets[i], sets[j]) if len(sets[i]) < len(sets[j]) else (sets[j], sets[i])
        at = np.searchsorted(y, x)
        at[at == len(y)] = 0
        out[k] = np.count_nonzero(y[at] == x)
    return out


def _compare(num: int, den: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        _, first, second = key
        rows = rows.drop_duplicates(["rep", "key"]).sort_values(["rep", "key"], ignore_index=True)
        bands, block = np.vstack(rows["bands"].to_numpy()), rows["block"].to_numpy()
        rep, size = rows["rep"].to_numpy(), rows["size"].to_numpy()
        left, right = np.flatnonzero(block == first), np.flatnonzero(block == second)
        i, j = _meeting(bands, left, right)
        a, b = left[i], right[j]
        if first == second:
            a, b = a[a < b], b[a < b]
        sets = [np.frombuffer(x, np.uint64) for x in rows["grams"]]
        n = np.array([len(s) for s in sets], np.int64)
        # common / (n_a + n_b - common) >= num / den, and no pair whose sizes alone rule it out
        ok = (np.minimum(n[a], n[b]) * den >= np.maximum(n[a], n[b]) * num) & (rep[a] != rep[b])
        a, b = a[ok], b[ok]
        ok = _common(sets, a, b) * (num + den) >= num * (n[a] + n[b])
        a, b = a[ok], b[ok]
        links = np.bincount(a, size[b], len(rows)) + np.bincount(b, size[a], len(rows))
        least, before = rep.copy(), None
        while before is None or (least != before).any():  # along links, until each class knows the least one it reaches in this block pair
            before = least.copy()
            np.minimum.at(least, a, least[b])
            np.minimum.at(least, b, least[a])
        some = links > 0
        return pd.DataFrame({"rep": rep[some], "links": links[some].astype(np.int64), "least": least[some]})

    return run


def linked(docs: DataFrame, threshold: tuple[int, int] = THRESHOLD, trees: int = TREES, full: int = FULL, recall: float = RECALL) -> DataFrame:
    """One row per document row: doc_id, copy_id (least document of the same words), class_id (least document reached over links) and n_links."""
    rows = stored(signed(docs, trees, full, threshold))
    length = reached(shared_prefixes(rows), trees, full, threshold, recall)
    classes = stored(
        rows.where("key IS NOT NULL AND doc_id IS NOT NULL").withColumn("bands", _nodes(length)).groupBy("key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("size"), F.any_value("n").alias("n"), F.any_value("bands").alias("bands"))
    )
    spread = classes.select("rep", F.explode("bands").alias("band"))
    groups = spread.groupBy("band").agg(F.min("rep").alias("least"), F.max("rep").alias("most")).where("least < most").select("band", "least")
    near = components(spread.join(groups, "band").select(F.col("rep").alias("a"), F.col("least").alias("b")))
    member = stored(near.unionByName(near.select(F.col("root").alias("node"), "root").distinct()))
    member = classes.join(member, F.col("rep") == F.col("node")).drop("node")
    blocks = member.groupBy(F.col("root").alias("r")).agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    member = member.join(blocks, F.col("root") == F.col("r")).withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    texts = docs.select(F.col("doc_id").alias("id"), "text").join(member, F.col("id") == F.col("rep"))
    sets = _with_shingles(texts.select("text", "rep", "key", "size", "bands", "root", "blocks", "block"))
    work = sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    work = work.withColumns({"first": F.least("block", "other"), "second": F.greatest("block", "other")}).select("rep", "key", "size", "bands", "block", "grams", "root", "first", "second")
    found = stored(work.groupBy("root", "first", "second").applyInPandas(_compare(*threshold), "rep long, links long, least long"))
    root = components(found.select(F.col("rep").alias("a"), F.col("least").alias("b")))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    info = classes.select("key", "rep", "size").join(links, "rep", "left").join(root, F.col("rep") == F.col("node"), "left")
    info = info.select(F.col("key").alias("k"), F.col("rep").alias("copy_id"), F.coalesce("root", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"))
    out = rows.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("key")).alias("key")).join(info, F.col("key") == F.col("k"), "left")
    return out.select("doc_id", F.coalesce("copy_id", "doc_id").alias("copy_id"), F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents without those that are linked, directly or over others, to a document of smaller id. Rows of one doc_id stay or go together."""
    gone = stored(linked(docs).where("doc_id <> class_id").select(F.col("doc_id").alias("gone_")).distinct())
    return docs.join(gone, docs["doc_id"] == gone["gone_"], "left_anti")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of every document."""
    return linked(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op6_jaccard_join": op6_jaccard_join}
