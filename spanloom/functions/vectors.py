"""Vectors as ARRAY columns, and hashed text vectors."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import half_even

# Size and weights of the hashed profile.
DIMENSIONS = 384
WORD_NGRAMS = (1, 2)
CHAR_NGRAMS = (3, 4, 5)
WORD_WEIGHT = 1.0
CHAR_WEIGHT = 0.55


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, v: acc + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    n = norm(a) * norm(b)
    return half_even(F.when(n > 0, dot(a, b) / n).otherwise(0.0), 4)


def normalize(a: Column) -> Column:
    n = F.greatest(norm(a), F.lit(1e-12))
    return F.transform(a, lambda x: x.cast("double") / n)


def word_ngrams(tokens: Column, n: int) -> Column:
    idx = F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.size(tokens) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(idx, lambda i: F.array_join(F.slice(tokens, i, F.lit(n)), " "))


_WORD = re.compile(r"[A-Za-z0-9_]+|[一-鿿]")


MEMO = 500_000  # features of a kind that a worker remembers
PART = 1 << 19  # characters whose n-grams are told apart at once
CODE = 12  # bits of a character in the number of an n-gram


def _place(kind: str, feature: str, dimensions: int) -> int:
    """Twice the bucket of a feature, plus one where its sign is minus."""
    raw = int.from_bytes(hashlib.blake2b(f"{kind}:{feature}".encode(), digest_size=8).digest(), "big")
    return raw % dimensions * 2 + (raw >> 63)


def _digest_place(kind: str, feature: str, dimensions: int) -> int:
    """The same from the hexadecimal MD5 digest: the bucket from its first eight digits, the sign from its last."""
    digest = hashlib.md5(f"{kind}:{feature}".encode(), usedforsecurity=False).hexdigest()
    return int(digest[:8], 16) % dimensions * 2 + (digest[31] >= "8")


def _places(kind: str, features: list[str], known: dict[str, int], dimensions: int, place_of: Callable[[str, str, int], int] = _place) -> np.ndarray:
    """Places of features; each is hashed when it is first met."""
    places = list(map(known.get, features))
    if None in places:
        if len(known) > MEMO:
            known.clear()
        for i, place in enumerate(places):
            if place is None:
                place = known.get(features[i])
                places[i] = known[features[i]] = place_of(kind, features[i], dimensions) if place is None else place
    return np.array(places, np.int64)


def _char_places(padded: list[str], known: dict[str, int], dimensions: int, place_of: Callable[[str, str, int], int] = _place) -> Iterator[tuple[int | np.ndarray, np.ndarray]]:
    """(text or texts, places) of the characters of texts by three, four and five. Equal n-grams are found as numbers, over all texts at once, and looked up once."""
    codes = [np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in padded]
    narrow = np.array([bool(len(c)) and int(c.max()) < 1 << CODE for c in codes], bool)
    some = np.flatnonzero(narrow).tolist()
    flat = np.concatenate([codes[k] for k in some]).astype(np.int64) if some else np.empty(0, np.int64)
    joined, text = "".join(padded[k] for k in some), np.repeat(some, [len(codes[k]) for k in some]).astype(np.int64)
    for n in CHAR_NGRAMS:
        for k in np.flatnonzero(~narrow).tolist():
            yield k, _places("c", [padded[k][i : i + n] for i in range(len(padded[k]) - n + 1)], known, dimensions, place_of)
        if len(flat) >= n:
            number = np.zeros(len(flat) - n + 1, np.int64)
            for j in range(n):
                number = (number << CODE) | flat[j : len(flat) - n + 1 + j]
            inside = np.flatnonzero(text[: len(number)] == text[n - 1 :])
            _, first, which = np.unique(number[inside], return_index=True, return_inverse=True)
            yield text[inside], _places("c", [joined[i : i + n] for i in inside[first].tolist()], known, dimensions, place_of)[which]


def digest_buckets(rows: list[tuple[list[str], str]], known: tuple[dict[str, int], dict[str, int]], dimensions: int) -> tuple[np.ndarray, ...]:
    """(text, bucket, words, chars) of the buckets that texts fill, in order: signed counts of word and of character features.

    A text comes as its words and its lower-case form between two blanks.
    """
    size = 2 * dimensions
    counts = [np.zeros(len(rows) * size, np.int64) for _ in range(2)]
    for k, (tokens, _) in enumerate(rows):
        places = _places("w", [*tokens, *map(" ".join, zip(tokens, tokens[1:]))], known[0], dimensions, _digest_place)
        counts[0][k * size : (k + 1) * size] = np.bincount(places, minlength=size)
    for owner, places in _char_places([packed for _, packed in rows], known[1], dimensions, _digest_place):
        counts[1] += np.bincount(owner * size + places, minlength=len(counts[1]))
    plus_minus = [c.reshape(-1, 2) for c in counts]
    filled = np.flatnonzero((plus_minus[0] + plus_minus[1]).any(axis=1))
    return filled // dimensions, filled % dimensions, *[(c[:, 0] - c[:, 1])[filled] for c in plus_minus]


def hash_embed(texts: list[str], known: tuple[dict[str, int], dict[str, int]], dimensions: int = DIMENSIONS) -> np.ndarray:
    """Unit vectors of texts from signed buckets of their features: words, pairs of words, then characters by three, four and five.

    Equal n-grams of characters are found as numbers, over all texts at once, and looked up once. Features of a text are added up
    in their order, so a vector does not depend on the texts beside it.
    """
    owner, place, weight = [], [], []

    def add(text: int | np.ndarray, at: np.ndarray, value: float) -> None:
        owner.append(np.full(len(at), text) if isinstance(text, int) else text)
        place.append(at)
        weight.append(np.where(at & 1, -value, value))

    padded = []
    for k, text in enumerate(texts):
        low = text.lower()
        tokens = _WORD.findall(low)
        add(k, _places("w", [*tokens, *map(" ".join, zip(tokens, tokens[1:]))], known[0], dimensions), WORD_WEIGHT)
        packed = " ".join(low.split())
        padded.append(f" {packed} " if packed else "")
    for owners, at in _char_places(padded, known[1], dimensions):
        add(owners, at, CHAR_WEIGHT)
    at = np.concatenate(place) if place else np.empty(0, np.int64)
    cells = np.concatenate(owner) * dimensions + (at >> 1) if place else at
    total = np.bincount(cells, weights=np.concatenate(weight) if weight else None, minlength=len(texts) * dimensions).reshape(len(texts), dimensions).astype(np.float64)
    lengths = np.array([np.linalg.norm(v) or 1.0 for v in total])
    return (total / lengths[:, None]).astype(np.float32) if len(texts) else total.astype(np.float32)


def hash_embed_udf(dimensions: int = DIMENSIONS):
    """Arrow function text -> array<float>: signed buckets from a 64-bit BLAKE2b digest, unit length. Spark has no BLAKE2b."""

    def embed(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: tuple[dict[str, int], dict[str, int]] = ({}, {})
        for batch in texts:
            out, part, size = [], [], 0
            for text in [*batch.fillna("").tolist(), None]:
                if text is None or size > PART:
                    out.extend(hash_embed(part, known, dimensions))
                    part, size = [], 0
                if text is not None:
                    part.append(text)
                    size += len(text)
            yield pd.Series(out)

    return F.pandas_udf(embed, "array<float>")
