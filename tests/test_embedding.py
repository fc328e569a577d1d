"""Hashed text vectors against a plain restatement, bit by bit, whatever texts share a batch."""

import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from spanloom.functions import vectors


def plain(text, dimensions=384):
    low = text.lower()
    tokens = re.findall(r"[A-Za-z0-9_]+|[一-鿿]", low)
    features = [("w:" + " ".join(tokens[i : i + n]), 1.0) for n in (1, 2) for i in range(len(tokens) - n + 1)]
    packed = " ".join(low.split())
    padded = f" {packed} " if packed else ""
    features += [("c:" + padded[i : i + n], 0.55) for n in (3, 4, 5) for i in range(len(padded) - n + 1)]
    vector = np.zeros(dimensions)
    for feature, weight in features:
        raw = int.from_bytes(hashlib.blake2b(feature.encode(), digest_size=8).digest(), "big")
        vector[raw % dimensions] += -weight if raw >> 63 else weight
    length = np.linalg.norm(vector)
    return (vector / (length or 1.0)).astype(np.float32)


def texts():
    rnd = random.Random(6)
    made = [" ".join("".join(rnd.choice("abcdeéß 0") for _ in range(rnd.randint(1, 7))) for _ in range(rnd.randint(0, 80))) for _ in range(60)]
    return [*made, "", " ", "a", "ab", "日本 heart 語", "x" * 500, "heart failure\n\theart  failure", "ä😀b", made[0], made[0].upper()]


def test_vectors_are_bit_equal(monkeypatch):
    for part in (1 << 19, 40):
        monkeypatch.setattr(vectors, "PART", part)
        got = vectors.hash_embed(texts(), ({}, {}))
        assert all((v == plain(t)).all() for v, t in zip(got, texts()))
    known = ({}, {})
    alone = [vectors.hash_embed([t], known)[0] for t in texts()]
    assert all((v == plain(t)).all() for v, t in zip(alone, texts()))
    monkeypatch.setattr(vectors, "MEMO", 5)
    assert all((v == plain(t)).all() for v, t in zip(vectors.hash_embed(texts(), ({}, {})), texts()))
    assert vectors.hash_embed([], ({}, {})).shape == (0, vectors.DIMENSIONS)


def test_vectors_of_a_column(spark, monkeypatch):
    df = spark.createDataFrame([(k, t) for k, t in enumerate([*texts(), None])], "id int, text string").repartition(3)
    got = {r.id: r.v for r in df.select("id", vectors.hash_embed_udf()(F.col("text")).alias("v")).collect()}
    assert all((np.array(got[k], np.float32) == plain(t or "")).all() for k, t in enumerate([*texts(), None]))
