"""Language of a text from averaged embeddings of hashed subwords and a linear softmax.

Subwords are runs of two to four bytes of the lower-cased text around a letter, hashed to ``BUCKETS`` vectors. A text is the mean
of its vectors, and a linear layer gives a score for each language. Vectors and layer are trained together by stochastic gradient
descent on snippets of labelled texts, from single words to hundreds, as many of each language. A part of the labelled texts is
kept back to calibrate: a temperature that makes probabilities honest, and the least probability at which answers are right
as often as ``RIGHT``; answers below it are rejected. At most about ``PER_LANG`` texts of a language are used for fitting. For
scoring, vectors and layer fold into one table of language scores per bucket, and every text is summed up whole.

NULL texts and texts without a letter are ``und`` with score 0. With no labelled text at all every text is. NULL labels are not
learnt from. Repeated rows get the same answer. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PER_LANG = 800
BUCKETS, WIDTH = 1 << 15, 16
RIGHT = 0.98
BLOCK = 1 << 20
UNKNOWN = "und"

# Bytes of letters keep their value in lower case, all else is a blank.
LETTER = np.zeros(256, bool)
LETTER[0x41:0x5B] = LETTER[0x61:0x7B] = LETTER[0x80:] = True
FOLD = np.where(LETTER, np.arange(256), 0x20).astype(np.uint32)
FOLD[0x41:0x5B] += 0x20


def subwords(raw: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length: the bucket of the subword at every byte, and whether it counts."""
    code, letter = FOLD[raw], LETTER[raw]
    out = []
    h = code * np.uint32(0x9E3779B1)
    for n in (2, 3, 4):
        h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA77) + code[n - 1 :] * np.uint32(0xC2B2AE3D) if len(h) > 1 else h[:0]
        out.append(((((h ^ (h >> np.uint32(13))) * np.uint32(0x27D4EB2F)) >> np.uint32(17)).astype(np.int32), letter[n // 2 : n // 2 + len(h)]))
    return out


def _padded(text: bytes) -> np.ndarray:
    return np.frombuffer(b" " + text + b"   ", np.uint8)


def _bag(text: bytes) -> np.ndarray:
    return np.concatenate([b[ok] for b, ok in subwords(_padded(text))])


def _snippet(words: list[bytes], rng: np.random.Generator) -> bytes:
    """A run of words; lengths from one word to 200, short ones as likely as long ones."""
    n = int(round(2 ** rng.uniform(0, 7.6)))
    at = int(rng.integers(0, max(1, len(words) - n + 1)))
    return b" ".join(words[at : at + n])


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(texts: list[str], langs: list[str], steps: int = 800, batch: int = 48, seed: int = 5) -> dict:
    """Folded table, languages, temperature and least probability, from labelled texts."""
    names = sorted(set(langs))
    if not names:
        return {"names": []}
    rng = np.random.default_rng(seed)
    target = np.array([names.index(x) for x in langs])
    data = [t.encode().split() for t in texts]
    order = rng.permutation(len(data))
    usable = [k for k in order if data[k]]
    kept_back = set(usable[: len(usable) // 5])
    groups = [[k for k in usable if target[k] == c and k not in kept_back] or [k for k in usable if target[k] == c] for c in range(len(names))]
    groups = [g for g in groups if g]
    vectors = rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32)
    layer, bias = np.zeros((WIDTH, len(names)), np.float32), np.zeros(len(names), np.float32)
    for step in range(steps if groups else 0):
        rate = np.float32(0.6 * (1 - step / steps))
        picks = [groups[g][rng.integers(len(groups[g]))] for g in rng.integers(len(groups), size=batch)]
        bags = [_bag(_snippet(data[k], rng)) for k in picks]
        y = target[picks]
        sizes = np.array([max(1, len(b)) for b in bags])
        owner, index = np.repeat(np.arange(batch), [len(b) for b in bags]), np.concatenate(bags)
        mean = np.zeros((batch, WIDTH), np.float32)
        np.add.at(mean, owner, vectors[index])
        mean /= sizes[:, None]
        error = _softmax(mean @ layer + bias)
        error[np.arange(batch), y] -= 1
        error /= batch
        back = (error @ layer.T) / sizes[:, None] * np.float32(BUCKETS // 512)
        layer -= rate * 5 * (mean.T @ error)
        bias -= rate * error.sum(axis=0)
        np.add.at(vectors, index, -rate * back[owner].astype(np.float32))
    model = {"names": names, "table": vectors @ layer, "bias": bias, "temperature": 1.0, "least": 0.0}
    check = [k for k in usable if k in kept_back] or usable
    snippets = [_snippet(data[k], rng) for k in check for _ in range(3)]
    y = np.repeat(target[check], 3)
    raw = logits(model, snippets)
    grid = [2 ** (e / 4) for e in range(-16, 17)]
    loss = [-np.log(_softmax(raw / t)[np.arange(len(y)), y] + 1e-12).mean() for t in grid]
    model["temperature"] = grid[int(np.argmin(loss))]
    p = _softmax(raw / model["temperature"])
    top, good = p.max(axis=1), p.argmax(axis=1) == y
    order = np.argsort(-top, kind="stable")
    share = np.cumsum(good[order]) / np.arange(1, len(order) + 1)
    passing = np.flatnonzero(share >= RIGHT)
    model["least"] = float(top[order[passing[-1]]]) if len(passing) else 1.0
    return model


def logits(model: dict, texts: list[bytes]) -> np.ndarray:
    """Mean language scores of each text."""
    total, count = np.zeros((len(texts), len(model["names"]))), np.zeros(len(texts))
    group: list[int] = []
    parts: list[bytes] = []

    def flush() -> None:
        if not parts:
            return
        raw = np.frombuffer(b"".join(parts), np.uint8)
        ends = np.cumsum([len(p) for p in parts])
        starts = ends - [len(p) for p in parts]
        for bucket, ok in subwords(raw):
            values = model["table"][bucket]
            values *= ok[:, None]
            at = np.minimum(starts, len(bucket) - 1)
            np.add.at(total, group, np.add.reduceat(values, at, axis=0, dtype=np.float64))
            np.add.at(count, group, np.add.reduceat(ok.astype(np.int64), at))
        parts.clear()
        group.clear()

    size = 0
    for k, text in enumerate(texts):
        for at in range(0, len(text), BLOCK):
            parts.append(b" " + text[at : at + BLOCK] + b"    ")
            group.append(k)
            size += len(parts[-1])
            if size > BLOCK:
                flush()
                size = 0
    flush()
    return total / np.maximum(count, 1)[:, None] + model["bias"]


def answers(model: dict, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, probability and whether the answer is accepted."""
    known = np.array([bool(t) and any(map(str.isalpha, t)) for t in texts], bool)
    if not model["names"] or not len(texts):
        return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
    p = _softmax(logits(model, [(t or "").encode() for t in texts]) / model["temperature"])
    best = p.argmax(axis=1)
    score = np.where(known, p.max(axis=1), 0.0)
    return [model["names"][b] if k else UNKNOWN for b, k in zip(best, known)], score, known & (score >= model["least"])


def trained(docs: DataFrame, per_lang: int = PER_LANG) -> dict:
    """A model from about ``per_lang`` texts of each language, chosen by a hash of the id."""
    rows = docs.where("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL")
    counts = rows.groupBy("lang").count()  # a row per language
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    sample = rows.join(F.broadcast(counts), "lang").where(place.cast("decimal(38,0)") * F.col("count") < F.lit(per_lang * (1 << 40)).cast("decimal(38,0)")).select("doc_id", "lang", "text")
    picked = sorted((r["doc_id"], r["lang"], r["text"]) for r in sample.collect())
    return train([r[2] for r in picked], [r[1] for r in picked])


def identified(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, lang_pred, score and accepted of every text, in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score, accepted = answers(model, batch.column(1).to_pylist())
            yield pa.record_batch([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(accepted, pa.bool_())], names=["doc_id", "lang_pred", "score", "accepted"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, accepted boolean")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt from those outside the held-out quarter."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return identified(docs, trained(docs.where(~held))).select("doc_id", held.alias("held_out"), "lang_pred", "score", "accepted")


QUERIES = {"op2_language_id": op2_language_id}
