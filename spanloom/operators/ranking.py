"""Ranks inside groups that stay correct and parallel when one group holds a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.positions import with_position


def rank_in_group(df: DataFrame, keys: list[str], order: list, name: str = "rank") -> DataFrame:
    """1-based rank in each group, whatever its size.

    Rows are range-sorted by key and order over all tasks, and a rank is the distance to the first position of the group. A hot
    group is so spread over as many tasks as its rows ask for; only the first positions, a row per group, are joined back.
    """
    placed = with_position(df, [*keys, *order], "pos_")
    first = placed.groupBy(*[F.col(k).alias(f"{k}_of_") for k in keys]).agg(F.min("pos_").alias("first_"))
    same = [F.col(k).eqNullSafe(F.col(f"{k}_of_")) for k in keys]
    return placed.join(first, same).withColumn(name, F.col("pos_") - F.col("first_") + 1).select(*df.columns, name)


def top_k(df: DataFrame, keys: list[str], order: list, k: int, name: str = "rank") -> DataFrame:
    """First k rows of each group; every task keeps only its own k before the shuffle."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= k)
