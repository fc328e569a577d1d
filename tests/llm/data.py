"""Small document tables with every odd case, and plain restatements of the operators."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(rng: random.Random, n: int, alphabet: str = "abcdefgh") -> str:
    return " ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(2, 7))) for _ in range(n))


def documents() -> list[tuple]:
    rng = random.Random(3)
    base = [sentence(rng, rng.randint(60, 140)) for _ in range(12)]
    near = base[1].split()
    near[40] = "changed"
    passage = sentence(rng, 30)
    texts = [
        *base, base[0], base[0], " ".join(near), base[2] + " " + passage, passage + " " + base[3], base[4].upper(), base[5] + "\n" + base[5],
        "", "   \n\t ", "word", "the end", "the end", "é" * 70, "a" * 300, "x y " * 200, base[6] + " " + "long tail " * 3000,
        base[7] + ' token = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b" ' + base[8], "### $$$ %%% " * 40, "line one here\n" * 30, "日本語のテキスト " * 12,
    ]
    rows = [(k * 3 + 1, t, ("en", "de", None)[k % 3], ("s1", "s1", "s1", "s2", None)[k % 5], len(t)) for k, t in enumerate(texts)]
    return [*rows, rows[5], (500, None, "en", "s1", None), (501, None, None, None, None), (None, base[0], "en", "s1", 5), (None, None, None, None, None)]


def frame(spark, rows=None, extra: bool = True):
    """The rows as a table, by default with columns whose names the operators use themselves."""
    df = spark.createDataFrame(documents() if rows is None else rows, SCHEMA)
    if extra:
        for name in ("kept", "n_words", "key", "hits", "shard", "number", "copy", "mark", "grams", "gone_", "bad_", "row_", "text_", "score", "root", "node", "h_"):
            df = df.selectExpr("*", f"'clash' AS {name}")
    return df


def words(text: str | None) -> list[str]:
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def measures(text: str | None) -> tuple[int, int, int, int, int, bool]:
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    count = Counter(zip(w, w[1:], w[2:]))
    hit = {i + j for i in range(len(w) - 2) if count[w[i], w[i + 1], w[i + 2]] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w))


def shingles(text: str | None) -> frozenset:
    w = words(text)
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def links(rows: list[tuple]) -> tuple[Counter, dict]:
    """Links and least reachable id of the rows (doc_id, text) with an id."""
    rows = [(i, shingles(t)) for i, t in rows if i is not None]
    n, parent = Counter(), {i: i for i, _ in rows}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (a, s) in enumerate(rows):
        for b, t in rows[:k]:
            if s and t and 5 * len(s & t) >= 4 * len(s | t):
                n[a] += 1
                n[b] += 1
                x, y = top(a), top(b)
                parent[max(x, y)] = min(x, y)
    return n, {i: top(i) for i, _ in rows}


def removed(rows: list[tuple], long: int = 50) -> dict:
    """(n_bytes, n_removed, n_spans, kept_sha256) of every row with an id."""
    held = defaultdict(lambda: 1 << 60)
    data = [(i, (t or "").encode()) for i, t in rows if i is not None]
    for i, b in data:
        for p in range(len(b) - long + 1):
            held[b[p : p + long]] = min(held[b[p : p + long]], i)
    out = {}
    for i, b in data:
        gone = bytearray(len(b))
        for p in range(len(b) - long + 1):
            if held[b[p : p + long]] < i:
                gone[p : p + long] = b"\1" * long
        spans = sum(1 for k in range(len(b)) if gone[k] and (not k or not gone[k - 1]))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    return out


def hits(text: str | None, items: list[tuple], span: int = 10) -> tuple[int, int, set]:
    w = words(text)
    hit, found = set(), set()
    for item, t in items:
        v = words(t)
        m = min(len(v), span)
        windows = {tuple(v[k : k + m]) for k in range(len(v) - m + 1)} if m else set()
        for p in range(len(w) - m + 1):
            if tuple(w[p : p + m]) in windows:
                hit |= set(range(p, p + m))
                found.add(item)
    return len(w), len(hit), found
