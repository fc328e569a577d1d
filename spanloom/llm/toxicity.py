"""Toxicity by a support vector machine over a subsequence string kernel with Nyström landmarks.

The kernel compares two words by the letter triples they hold in order, not necessarily side by side: a triple that spans d + 1
characters weighs ``DECAY ** d``, up to ``REACH``, so a word with characters put in between keeps most of its triples. Words are
what white space parts, and single letters that stand alone in a row are one word. Signs among the letters do not count at all. Landmarks are words of the
training texts; the Nyström map turns kernel values with them into coordinates, and a linear machine is trained there. Its
decision is a sum over landmark kernels, so it folds into one weight per triple, and scoring looks up the triples of a text.

A text is as toxic as its worst word. Labels are of whole texts, so the words that toxic texts stand out by are the examples for,
with copies that have a character put in. Training alternates: words that score high in harmless texts become examples against, and
landmarks are chosen anew among them. At the end a logistic curve over worst-word scores, fitted
on the labels, gives a probability. At most ``SAMPLE`` texts of a label are used for fitting; every text is scored whole.

NULL, empty and wordless texts get the score of a text without triples. Without texts of both labels every score is the share of toxic ones
among the labelled (0 without any). Labels other than 0 and 1 and NULL labels are not learnt from. Repeated rows score alike. Other
columns are ignored.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import stored

SAMPLE = {1: 1500, 0: 3000}
LANDMARKS, ROUNDS = 256, 4
DECAY, REACH = 0.7, 5
BLOCK = 1 << 20
SIDE = 33  # letters, six classes of accented letters, all else
OTHER = SIDE - 1

CODE = np.full(256, OTHER, np.int32)
CODE[0x61:0x7B] = np.arange(26)
CODE[0x41:0x5B] = np.arange(26)
# The second byte of Latin letters outside ASCII: a class for each vowel below the accent and one for the other letters.
ACCENTED = np.full(256, OTHER, np.int32)
for _c in [*range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)]:
    ACCENTED[chr(_c).encode()[1]] = 26 + ("aeiou".find(unicodedata.normalize("NFD", chr(_c))[0].lower()) % 6)
SIGN = np.zeros(256, bool)
for _a, _b in ((0x21, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E)):
    SIGN[_a : _b + 1] = True
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def units(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words start and end in the bytes of texts; rows of single letters count as one word, but three or more equal ones stay apart."""
    space = np.ones(len(raw) + 2, bool)
    space[1:-1] = SPACE[raw]
    edges = np.flatnonzero(space[1:] != space[:-1])
    starts, ends = edges[::2], edges[1::2]
    single = (ends - starts == 1) & (CODE[raw[starts]] < OTHER)
    joined = single[1:] & single[:-1] & (starts[1:] - ends[:-1] == 1)
    equal = joined & (CODE[raw[starts[1:]]] == CODE[raw[starts[:-1]]])
    more = np.zeros(len(equal) + 2, bool)
    more[1:-1] = equal
    joined &= ~(equal & (more[:-2] | more[2:]))
    first, last = np.concatenate(([True], ~joined)), np.concatenate((~joined, [True]))
    return (starts[first], ends[last]) if len(starts) else (starts, ends)


def codes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letter codes of the characters that count, and their places: no signs and no white space."""
    lead = raw == 0xC3
    after = np.zeros(len(raw), bool)
    after[1:] = lead[:-1]
    kept = np.flatnonzero(~(SIGN | SPACE)[raw] & ~lead)
    return np.where(after[kept], ACCENTED[raw[kept]], CODE[raw[kept]]), kept


def norms(letters: np.ndarray) -> np.ndarray:
    """Length of a word's triple vector when it has so many letters and none repeats."""
    total = sum(np.maximum(letters - d, 0) * (d - 1) * DECAY ** (2 * d) for d in range(2, REACH + 1))
    return np.sqrt(np.maximum(total, DECAY**4))


def word_scores(raw: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sum of triple weights of each word over its norm, and where each word starts."""
    starts, _ = units(raw)
    if not len(starts):
        return np.empty(0, np.float32), starts
    mark = np.zeros(len(raw), np.int32)
    mark[starts] = 1
    code, kept = codes(raw)
    word = (np.cumsum(mark, dtype=np.int32) - 1)[kept]
    if not len(kept):
        return np.zeros(len(starts), np.float32), starts
    high, middle = code * (SIDE * SIDE), code * SIDE
    total = np.zeros(len(code), np.float32)
    for d in range(2, REACH + 1):
        n = len(code) - d
        if n <= 0:
            break
        part = np.zeros(n, np.float32)
        for j in range(1, d):
            part += weights[high[:n] + middle[j : j + n] + code[d:]]
        part *= word[:n] == word[d:]
        total[:n] += np.float32(DECAY**d) * part
    first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
    letters = np.add.reduceat((code < OTHER).astype(np.int32), first)
    out = np.zeros(len(starts), np.float32)
    out[word[first]] = np.add.reduceat(total, first) / norms(letters).astype(np.float32)
    return out, starts


def worst(texts: list[bytes], weights: np.ndarray) -> np.ndarray:
    """The highest word score of each text; 0 where there is none higher, as for a text without triples."""
    out = np.zeros(len(texts), np.float32)
    group: list[tuple[int, bytes]] = []

    def flush() -> None:
        if not group:
            return
        raw = np.frombuffer(b"\n\n".join(t for _, t in group), np.uint8)
        scores, at = word_scores(raw, weights)
        begin = np.cumsum([0] + [len(t) + 2 for _, t in group])[:-1]
        if len(scores):
            owner = np.searchsorted(begin, at, side="right") - 1
            np.maximum.at(out, np.array([k for k, _ in group])[owner], scores)
        group.clear()

    size = 0
    for k, text in enumerate(texts):
        while len(text) > BLOCK:  # long texts go in parts, cut at white space where there is any
            cut = max(text.rfind(b" ", BLOCK // 2, BLOCK), text.rfind(b"\n", BLOCK // 2, BLOCK))
            cut = cut if cut > 0 else BLOCK
            group.append((k, text[:cut]))
            flush()
            text = text[cut:]
        group.append((k, text))
        size += len(text)
        if size > BLOCK:
            flush()
            size = 0
    flush()
    return out


def triple_vectors(words: list[str], seen: dict) -> np.ndarray:
    """A row for each word: the weights of its triples over its norm. ``seen`` keeps the triples of words met before."""
    out = np.zeros((len(words), SIDE**3), np.float32)
    for row, word in enumerate(words):
        if word not in seen:
            code = codes(np.frombuffer(word.encode(), np.uint8))[0].tolist()
            spans = [(i, i + j, i + d, d) for i in range(len(code)) for d in range(2, min(REACH, len(code) - 1 - i) + 1) for j in range(1, d)]
            triples = [((code[i] * SIDE + code[j]) * SIDE + code[k], DECAY**d) for i, j, k, d in spans if OTHER not in (code[i], code[j], code[k])]
            seen[word] = (np.array([t for t, _ in triples], np.int64), np.array([v for _, v in triples]) / norms(np.array(sum(c < OTHER for c in code))))
        np.add.at(out[row], seen[word][0], seen[word][1])
    return out


def _machine(x: np.ndarray, y: np.ndarray, times: np.ndarray, strength: float = 0.02) -> tuple[np.ndarray, float]:
    """Newton steps on the squared hinge loss until the examples inside the margin stay the same.

    An example weighs as much as the texts that hold it; both classes weigh the same.
    """
    z = np.hstack([x, np.ones((len(x), 1))])
    weight = times * np.where(y > 0, len(y) / 2 / times[y > 0].sum(), len(y) / 2 / max(times[y < 0].sum(), 1))
    ridge = np.full(z.shape[1], strength)
    w, active = np.zeros(z.shape[1]), np.ones(len(y), bool)
    for _ in range(50):
        a = z[active] * weight[active, None]
        new = np.linalg.solve(a.T @ z[active] + np.diag(ridge), a.T @ y[active])
        w = new if _ < 10 else (w + new) / 2
        now = y * (z @ w) < 1
        if (now == active).all():
            break
        active = now
    return w[:-1], float(w[-1])


def _inserted(word: str, rng: np.random.Generator) -> str:
    """The word with a character put between two of its letters."""
    at = int(rng.integers(1, max(2, len(word))))
    return word[:at] + str(rng.choice(list("abcdefghijklmnopqrstuvwxyz1"))) + word[at:]


def _curve(s: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve that fits labels to scores, by damped Newton steps."""
    n1, n0 = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * s + b, -30, 30)))
        g, h = p - target, np.maximum(p * (1 - p), 1e-6)
        hess = np.array([[(h * s * s).sum() + 1e-3, (h * s).sum()], [(h * s).sum(), h.sum() + 1e-3]])
        step = np.linalg.solve(hess, np.array([(g * s).sum() + 1e-3 * a, g.sum()]))
        step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-9))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(a), float(b)


def _apart(texts: list[list[str]]) -> list[int]:
    """Texts that share less than a third of their least word hashes with an earlier one, so that copies do not vote twice."""
    holders: dict[int, list[int]] = {}
    out = []
    for k, words in enumerate(texts):
        least = sorted({zlib.crc32(w.encode()) for w in words})[:24]
        shared = Counter(o for h in least for o in holders.get(h, ()))
        if not shared or max(shared.values()) * 3 < len(least):
            out.append(k)
            for h in least:
                holders.setdefault(h, []).append(k)
    return out


def _telling(toxic: list[list[str]], other: list[list[str]]) -> list[str]:
    """The words that toxic texts stand out by, most frequent first: far more often in them than chance explains."""
    toxic, other = [toxic[k] for k in _apart(toxic)], [other[k] for k in _apart(other)]
    df1, df0 = Counter(w for t in toxic for w in t), Counter(w for t in other for w in t)
    odds = lambda w: df1[w] / len(toxic) * df1[w] / (df1[w] + 2) / ((df0[w] + 1) / max(len(other), 1))
    return sorted((w for w in df1 if df1[w] >= 3 and odds(w) > 6), key=lambda w: (-df1[w], w))[:800]


def _varied(words: list[str], n: int, seen: dict) -> list[str]:
    """Up to n of the words, each unlike those before it."""
    out: list[str] = []
    base = np.zeros((n, SIDE**3), np.float32)
    for w in words:
        v = triple_vectors([w], seen)[0]
        if len(out) < n and (not out or (base[: len(out)] @ v).max() < 0.8):
            base[len(out)] = v
            out.append(w)
    return out


def train(texts: list[str], labels: np.ndarray, seed: int = 11) -> dict:
    """Triple weights and the curve, from texts labelled 0 or 1."""
    rng = np.random.default_rng(seed)
    y = np.asarray(labels, int)
    if not len(y) or y.min() == y.max():
        return {"weights": None, "share": float(y.mean()) if len(y) else 0.0}
    data = [t.encode() for t in texts]
    words: list[list[str]] = []
    for t in data:
        raw = np.frombuffer(t, np.uint8)
        found = {t[s:e].decode("utf-8", "ignore").strip(".,;:!?\"'()").lower() for s, e in zip(*(a.tolist() for a in units(raw)))}
        words.append(sorted(w for w in found if 3 <= sum(c.isascii() and c.isalpha() for c in w) and len(w) <= 40))
    names = _telling([w for w, k in zip(words, y) if k], [w for w, k in zip(words, y) if not k])
    df0, df1 = Counter(w for t, k in zip(words, y) if not k for w in t), Counter(w for t, k in zip(words, y) if k for w in t)
    common = [w for w, _ in sorted(df0.items(), key=lambda p: (-p[1], p[0]))]
    against = common[:1500] + [common[i] for i in rng.choice(len(common), min(2500, len(common)), replace=False)] if common else []
    extra = [_inserted(w, rng) for w in names[:200] for _ in range(3)]
    weights, seen = np.zeros(SIDE**3, np.float32), {}
    first = _varied(names, LANDMARKS // 2, seen)
    for _ in range(ROUNDS if names else 0):
        against = [w for w in dict.fromkeys(against) if w not in set(names)]
        base = triple_vectors(first + _varied(against[::-1], LANDMARKS - len(first), seen), seen)
        value, vector = np.linalg.eigh(base @ base.T)
        keep = value > 1e-4 * value.max()
        root = vector[:, keep] / np.sqrt(value[keep])
        examples = names + extra + against
        z = np.concatenate([triple_vectors(examples[at : at + 512], seen) @ base.T @ root for at in range(0, len(examples), 512)])
        w, bias = _machine(z, np.array([1.0] * (len(names) + len(extra)) + [-1.0] * len(against)), np.array([df1[w] for w in names] + [df1[w] / 3 for w in names[:200] for _ in range(3)] + [max(1, df0[w]) ** 0.5 for w in against], float))
        weights = ((root @ w) @ base).astype(np.float32)
        hard: Counter = Counter()
        for k, t in enumerate(data):
            if y[k]:
                continue
            raw = np.frombuffer(t, np.uint8)
            s, at = word_scores(raw, weights)
            ends = units(raw)[1]
            for p in np.argsort(-s)[:3]:
                if s[p] + bias > -1:
                    hard[t[at[p] : ends[p]].decode("utf-8", "ignore").strip(".,;:!?\"'()").lower()] += 1
        against += [w for w, _ in reversed(hard.most_common(600)) if len(w) <= 60]
    slope, shift = _curve(worst(data, weights).astype(float), y)
    return {"weights": weights, "slope": slope, "shift": shift}


def probabilities(model: dict, texts: list[bytes]) -> np.ndarray:
    if model["weights"] is None:
        return np.full(len(texts), model["share"])
    return 1 / (1 + np.exp(-np.clip(model["slope"] * worst(texts, model["weights"]).astype(float) + model["shift"], -30, 30)))


def trained(docs: DataFrame, labels: DataFrame, sample: dict[int, int] = SAMPLE) -> dict:
    """A model from a bounded number of labelled texts of each label, taken in order of a hash."""
    marked = labels.where("toxic IN (0, 1)").select(F.col("doc_id").alias("id_"), F.col("toxic").cast("int").alias("y_")).distinct()
    chosen = [marked.where(F.col("y_") == y).orderBy(F.xxhash64("id_"), "id_").limit(sample[y]) for y in (0, 1)]
    picked = stored(chosen[0].unionByName(chosen[1]))
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("id_")).where("text IS NOT NULL").select("doc_id", "text", "y_").collect()  # the sample at most, but for repeated rows
    rows = sorted(rows, key=lambda r: (r["doc_id"], r["text"]))
    return train([r["text"] for r in rows], np.array([r["y_"] for r in rows], int))


def scored(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id and probability of every text, in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(v.as_py() or "").encode() for v in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(probabilities(model, texts), pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def held_out(divisor: int, rest: int):
    """Whether a document is kept from learning: crc32 of its id as text."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % divisor == rest, F.lit(False))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document, learnt from labels outside the held-out fifth."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = scored(docs, trained(docs, labels.where(~held_out(5, 0))))
    return rows.select("doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op8_toxicity": op8_toxicity}
