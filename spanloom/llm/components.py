"""Connected components of a graph given as pairs, by joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored


def _oriented(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()


def _flat(parents: DataFrame) -> DataFrame:
    """Parents replaced by their parents until every row names a root. The way halves each time."""
    while True:
        up = parents.select(F.col("node").alias("n"), F.col("root").alias("r"))
        jumped = stored(parents.join(up, F.col("root") == F.col("n"), "left").select("node", F.coalesce("r", "root").alias("root"), F.col("r").isNotNull().alias("moved")))
        parents = jumped.select("node", "root")
        if jumped.where("moved").isEmpty():
            return parents


def components(pairs: DataFrame) -> DataFrame:
    """(node, root) for every node of the pairs (a, b) that is not the least of its component; root is that least node.

    Each round hangs every node below its least smaller neighbour, flattens the trees and joins the roots' remaining pairs, which
    leaves at most half of the connected nodes. Rounds are written to the shared folder. Pairs of a popular node are aggregated
    with partial results or joined, so they never meet in one task as a group.
    """
    pairs = stored(_oriented(pairs))
    maps: list[DataFrame] = []
    while not pairs.isEmpty():
        parents = _flat(stored(pairs.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))))
        maps.append(parents)
        up = parents.select(F.col("node").alias("n"), F.col("root").alias("r"))
        half = pairs.join(up, F.col("a") == F.col("n")).select(F.col("r").alias("a"), "b")
        pairs = stored(_oriented(half.join(up, F.col("b") == F.col("n"), "left").select("a", F.coalesce("r", "b").alias("b"))))
    if not maps:
        return pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = maps[0]
    for later in maps[1:]:
        up = later.select(F.col("node").alias("n"), F.col("root").alias("r"))
        out = out.join(up, F.col("root") == F.col("n"), "left").select("node", F.coalesce("r", "root").alias("root")).unionByName(later)
    return stored(out.groupBy("node").agg(F.min("root").alias("root"))) if len(maps) > 1 else out
