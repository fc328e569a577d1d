"""A random forest of binary trees, grown level by level over a table of any size.

Every row counts in every tree, as often as a hash of it says (a Poisson number of mean one, what drawing with replacement comes to).
Tasks count rows by node, feature and bin; the counts of a tree are added up in one group, which picks its nodes' best splits. Their size follows from
the depth, the bins and ``TASKS``, not from the rows. What reaches the driver is one row for a node that is split. Counts are whole numbers, so the trees do not
depend on the order of the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import mix

BINS, TASKS = 32, 48
_POISSON = np.cumsum(np.exp(-1.0) / np.cumprod(np.maximum(np.arange(12), 1)))  # how often a row counts, as limits of a uniform number


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def limits(rows: DataFrame, width: int, bins: int = BINS) -> list[np.ndarray]:
    """Where each feature may be split: quantiles of the rows of each label, from sketches over all rows."""
    at = F.array(*[F.lit(k / bins) for k in range(bins + 1)])
    found = rows.groupBy("label").agg(*[F.percentile_approx(F.col("x")[f], at, 10_000).alias(f"f{f}") for f in range(width)]).collect()  # a row per label
    return [np.unique([v for r in found for v in r[f"f{f}"]]) for f in range(width)]


def _leaf(tree: dict, x: np.ndarray) -> np.ndarray:
    """The node of a tree at which each row ends."""
    at = np.zeros(len(x), np.int64)
    while True:
        f = tree["feature"][at]
        inner = np.flatnonzero(f >= 0)
        if not len(inner):
            return at
        low = x[inner, f[inner]] <= tree["limit"][at[inner]]
        at[inner] = np.where(low, tree["left"][at[inner]], tree["right"][at[inner]])


def _counts(trees: list[dict], open_: list[np.ndarray], features: list[np.ndarray], cuts: list[np.ndarray], seed: int):
    """Per tree: rows by open node, feature tried there, bin and kind."""
    most = max(len(c) for c in cuts) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros((*f.shape, most, 4), np.int32) for f in features]
        for batch in batches:
            x, key = _matrix(batch.column(0)), batch.column(2).to_numpy()
            kind = batch.column(1).to_numpy().astype(np.int64)
            bins = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
            for t, tree in enumerate(trees):
                if not len(features[t]):
                    continue
                place = open_[t][_leaf(tree, x)]
                draw = mix(key.view(np.uint64) + np.uint64((t + 1) * 0x9E3779B97F4A7C15 + seed & (1 << 64) - 1)) >> np.uint64(11)
                times = np.searchsorted(_POISSON, draw / float(1 << 53), side="right")
                rows = np.flatnonzero((place >= 0) & (times > 0))
                here = place[rows]
                for k in range(features[t].shape[1]):
                    np.add.at(totals[t], (here, k, bins[rows, features[t][here, k]], kind[rows]), times[rows])
        some = [t for t, total in enumerate(totals) if total.any()]
        yield pa.record_batch([pa.array(some, pa.int32()), pa.array([totals[t].tobytes() for t in some], pa.binary())], names=["tree", "counts"])

    return run


def _best(tries: int, most: int, weights: list[float], least: float):
    """For each open node of a tree the split that takes away most impurity: slot, bin and the weights of both labels on both sides."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        n = sum(np.frombuffer(c, np.int32).astype(np.int64) for c in rows["counts"]).reshape(-1, tries, most, 4)
        label = np.stack([n[..., y] * weights[y] + n[..., y + 2] * weights[y + 2] for y in (0, 1)])
        a = label.cumsum(axis=-1)
        whole = a[..., -1:]
        b = whole - a
        impure = lambda s: s[0] * s[1] / np.maximum(s[0] + s[1], 1e-300)
        gain = np.where((a.sum(axis=0) >= least) & (b.sum(axis=0) >= least), impure(whole) - impure(a) - impure(b), -1.0).reshape(len(n), -1)
        at = gain.argmax(axis=1)
        node = np.flatnonzero(gain[np.arange(len(n)), at] > 1e-9)
        slot, cut = at[node] // most, at[node] % most
        side = {f"{name}{y}": s[y][node, slot, cut] for name, s in (("a", a), ("b", b)) for y in (0, 1)}
        return pd.DataFrame({"tree": np.full(len(node), key[0]), "node": node, "slot": slot, "bin": cut, **side})

    return run


def fit(rows: DataFrame, width: int, weights: list[float], trees: int = 40, depth: int = 10, least: float = 2, seed: int = 7) -> list[tuple[np.ndarray, ...]]:
    """Trees over all rows (x, kind, key, label), each split chosen among a random part of the features.

    ``kind`` is the label, or the label and 2; ``weights`` says how much a row of each kind counts. The rows should be stored: they are read once a level.
    """
    rng = np.random.default_rng(seed)
    cuts, tries = limits(rows, width), max(1, round(width**0.5))
    rows = rows.select("x", "kind", "key").coalesce(max(1, min(TASKS, rows.count() // 4000)))  # few rows cost less than the start of a task
    grown = [{"feature": [-1], "limit": [0.0], "left": [-1], "right": [-1], "share": [0.5]} for _ in range(trees)]
    fresh = [[0] for _ in grown]
    for _ in range(depth):
        if not any(fresh):
            break
        packed = [{c: np.array(v) for c, v in tree.items()} for tree in grown]
        open_ = [np.full(len(tree["share"]), -1, np.int64) for tree in grown]
        for t, nodes in enumerate(fresh):
            open_[t][nodes] = np.arange(len(nodes))
        features = [np.array([rng.choice(width, tries, replace=False) for _ in nodes]).reshape(-1, tries) for nodes in fresh]
        counts = rows.mapInArrow(_counts(packed, open_, features, cuts, seed), "tree int, counts binary")
        best = counts.groupBy("tree").applyInPandas(_best(tries, max(len(c) for c in cuts) + 1, weights, least), "tree int, node int, slot int, bin int, a0 double, a1 double, b0 double, b1 double")
        later: list[list[int]] = [[] for _ in grown]
        for r in sorted(best.collect()):  # a row per open node at most
            t, f = r["tree"], int(features[r["tree"]][r["node"], r["slot"]])
            tree, node, here = grown[t], fresh[t][r["node"]], len(grown[t]["share"])
            tree["feature"][node], tree["limit"][node], tree["left"][node], tree["right"][node] = f, float(cuts[f][r["bin"]]), here, here + 1
            for side, (n0, n1) in enumerate(((r["a0"], r["a1"]), (r["b0"], r["b1"]))):
                for c, v in (("feature", -1), ("limit", 0.0), ("left", -1), ("right", -1), ("share", min(1.0, max(0.0, n1 / (n0 + n1))))):
                    tree[c].append(v)
                if min(n0, n1) > 1e-6 and n0 + n1 >= 2 * least:
                    later[t].append(here + side)
        fresh = later
    return [tuple(np.array(tree[c]) for c in ("feature", "limit", "left", "right", "share")) for tree in grown]


def predict(trees: list[tuple[np.ndarray, ...]], x: np.ndarray) -> np.ndarray:
    """Mean share of ones over the trees' leaves."""
    total = np.zeros(len(x))
    for feature, limit, left, right, share in trees:
        total += share[_leaf({"feature": feature, "limit": limit, "left": left, "right": right}, x)]
    return total / max(len(trees), 1)
