"""Passages shared with benchmark items, found by winnowing.

A document word is hit where it lies in a run of ``SPAN`` words that some item also holds; an item of fewer words counts as a
whole. Winnowing keeps, of the ``SPAN - GRAM + 1`` word grams in each window of ``SPAN`` words, the one of least hash, so every
shared run of that length has a gram that both texts keep. Kept grams are joined by hash and each match is extended word by
word to both sides; as far as the window reaches is enough, because overlapping windows have matches of their own. Items shorter
than ``SPAN`` are grams of their own length, looked up at every place.

Before the join, grams of documents are tested against a bit map of the item grams. It has ``BITS`` bits whatever the size of
either table, and it only removes grams that no item has. Only the matches of a document are shuffled, never texts, and they
carry the hashes of the few words around them. Words are compared by 64-bit hashes.

NULL and empty texts have no words. NULL items and items without words match nothing; a NULL item_id hits words but is in no
list. Each input row gives one row, repeated or not. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import gram_hashes, stored, word_hashes

SPAN, GRAM, BITS = 10, 5, 1 << 24
_HIT = "span int, hash long, place int, gram int, before array<long>, after array<long>"
_HIT_TYPE = pa.struct([("span", pa.int32()), ("hash", pa.int64()), ("place", pa.int32()), ("gram", pa.int32()), ("before", pa.list_(pa.int64())), ("after", pa.list_(pa.int64()))])


def kept_grams(words: np.ndarray, span: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the grams that winnowing keeps; of equal hashes in a window the first."""
    grams = gram_hashes(words, gram)
    width = span - gram + 1
    if len(grams) < width:
        return np.empty(0, np.int64), grams[:0]
    n = len(grams) - width + 1
    least, at = grams[:n].copy(), np.arange(n)
    for j in range(1, width):
        other = grams[j : j + n]
        less = other < least
        least[less] = other[less]
        at[less] = np.flatnonzero(less) + j
    at = at[np.concatenate(([True], at[1:] != at[:-1]))] if n else at
    at = np.unique(at)
    return at, grams[at]


def _around(words: np.ndarray, places: np.ndarray, hashes: np.ndarray, span: int, gram: int) -> list[dict]:
    signed, reach = words.view(np.int64), span - gram
    return [
        {"span": span, "hash": h, "place": p, "gram": gram, "before": signed[max(0, p - reach) : p][::-1].tolist(), "after": signed[p + gram : p + gram + reach].tolist()}
        for p, h in zip(places.tolist(), hashes.view(np.int64).tolist())
    ]


def _bytes(text) -> bytes:
    value = text.as_py()
    return value.encode() if value else b""


def item_grams(items: DataFrame, span: int, gram: int) -> DataFrame:
    """The kept grams of every item with the words around them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hits = [], []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words, _, _ = word_hashes(_bytes(text))
                if len(words):
                    s, g = (span, gram) if len(words) >= span else (len(words), len(words))
                    found = _around(words, *kept_grams(words, s, g), s, g)
                    hits += found
                    ids += [item] * len(found)
            yield pa.record_batch([pa.array(ids, pa.string()), pa.array(hits, _HIT_TYPE)], names=["item_id", "hit"])

    return items.select(F.col("item_id").cast("string"), "text").mapInArrow(run, f"item_id string, hit struct<{_HIT}>").select("item_id", "hit.*")


def document_grams(docs: DataFrame, spans: list[int], bitmap: np.ndarray, span: int, gram: int) -> DataFrame:
    """One row per document: a key, doc_id, n_words and those kept grams whose bit is set."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)
    mask = np.uint64(len(bitmap) * 64 - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, key = shared.value, TaskContext.get().partitionId() << 33
        for batch in batches:
            out: list = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words, _, _ = word_hashes(_bytes(text))
                hits = []
                for s in spans:
                    g = gram if s == span else s
                    places, hashes = kept_grams(words, s, g)
                    bit = hashes & mask
                    seen = (bits[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1
                    if seen.any():
                        hits += _around(words, places[seen], hashes[seen], s, g)
                out.append((key, doc_id, len(words), hits))
                key += 1
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), [pa.int64(), pa.int64(), pa.int64(), pa.list_(_HIT_TYPE)])], names=["key", "doc_id", "n_words", "hits"])

    return docs.select("doc_id", "text").mapInArrow(run, f"key long, doc_id long, n_words long, hits array<struct<{_HIT}>>")


def _agree(a: Column, b: Column) -> Column:
    """How many leading words two contexts share."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    first = F.array_position(same, F.lit(False))
    return F.when(first > 0, first - 1).otherwise(F.size(same)).cast("int")


def matches(grams: DataFrame, items: DataFrame) -> DataFrame:
    """Extended matches: document key, item, and the words [start, stop) they share."""
    left = grams.select("key", F.explode("hits").alias("hit")).select("key", "hit.*").alias("d")
    pairs = left.join(items.alias("i"), F.expr("d.hash = i.hash AND d.span = i.span"))
    pairs = pairs.select("key", "item_id", "d.span", "d.place", "d.gram", _agree(F.col("d.before"), F.col("i.before")).alias("l"), _agree(F.col("d.after"), F.col("i.after")).alias("r"))
    return pairs.where("l + gram + r >= span").select("key", "item_id", F.expr("place - l").alias("start"), F.expr("place + gram + r").alias("stop"))


def contamination(docs: DataFrame, items: DataFrame, span: int = SPAN, gram: int = GRAM, bits: int = BITS) -> DataFrame:
    """One row per document row: doc_id, n_words, n_hit, the items and the hit runs."""
    prints = stored(item_grams(items, span, gram))
    word = F.col("hash").bitwiseAND(F.lit(bits - 1))
    cells = prints.groupBy(F.shiftright(word, 6).alias("cell")).agg(F.bit_or(F.expr(f"1L << CAST(hash & 63 AS INT)")).alias("bits")).collect()  # at most bits / 64 rows
    bitmap = np.zeros(bits // 64, np.uint64)
    for c in cells:
        bitmap[c["cell"]] = np.uint64(c["bits"] & 0xFFFFFFFFFFFFFFFF)
    spans = sorted(r["span"] for r in prints.select("span").distinct().collect())  # at most ``span`` values
    grams = stored(document_grams(docs, spans, bitmap, span, gram))
    found = matches(grams, prints).groupBy("key").agg(F.collect_set(F.struct("start", "stop")).alias("runs"), F.array_sort(F.collect_set("item_id")).alias("items"))
    union = F.aggregate(
        F.sort_array("runs"), F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda a, x: F.struct(F.greatest(a["end"], x["stop"]).alias("end"), (a["n"] + F.greatest(x["stop"] - F.greatest(x["start"], a["end"]), F.lit(0))).alias("n")),
        lambda a: a["n"],
    )
    found = found.select("key", "items", F.sort_array("runs").alias("runs"), union.cast("long").alias("n_hit"))
    rows = grams.select("key", "doc_id", "n_words").join(found, "key", "left")
    return rows.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce("runs", F.array().cast("array<struct<start:int,stop:int>>")).alias("runs"),
    )


def clean_documents(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents without a hit word, with the columns they came with. Rows of one doc_id go together."""
    bad = stored(contamination(docs, items).where("n_hit > 0").select(F.col("doc_id").alias("bad_")).distinct())
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["bad_"]), "left_anti")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit words and matching items of every document."""
    rows = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return rows.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def contamination_sql(docs: str = "documents") -> str:
    """DuckDB statement: every window of every item looked up at every place of every document."""
    words = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH d AS (SELECT doc_id, {words} AS w FROM {docs}),
i AS (SELECT item_id, w, least(len(w), {SPAN}) AS m FROM (SELECT item_id, {words} AS w FROM benchmark) WHERE len(w) > 0),
probes AS (SELECT DISTINCT item_id, m, array_to_string(w[p : p + m - 1], ' ') AS x FROM (SELECT item_id, w, m, unnest(range(1, len(w) - m + 2)) AS p FROM i)),
sizes AS (SELECT DISTINCT m FROM i),
places AS (SELECT doc_id, m, p, array_to_string(w[p : p + m - 1], ' ') AS x FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS p FROM d, sizes WHERE len(w) >= m)),
hits AS (SELECT doc_id, p, places.m, item_id FROM places JOIN probes ON places.x = probes.x AND places.m = probes.m),
covered AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + m)) AS q FROM (SELECT DISTINCT doc_id, p, m FROM hits)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""


QUERIES = {"op7_decontamination": op7_decontamination}
STATEMENTS = {"op7_decontamination": contamination_sql()}
