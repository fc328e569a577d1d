"""Upserts, lookups and merges over Parquet tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import markup as mk
from ..operators.stats import one_row
from ..schema import SPAN_DDL, TERMINAL_RUN_STATUSES
from .generations import newest


def latest(df: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The newest row per key; rows of one version are decided by their other columns. Rewrites of one key collapse before the shuffle."""
    return newest(df, keys, [version])


def upsert(table: DataFrame, updates: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Insert or replace: for each key the row with the highest version wins."""
    return latest(table.unionByName(updates, allowMissingColumns=True), keys, version)


def upsert_partitions(table: DataFrame, updates: DataFrame, keys: list[str], version: str, partition: str) -> DataFrame:
    """The rows of the touched partitions after an upsert, ready for a dynamic partition overwrite."""
    touched = updates.select(partition).distinct()
    return upsert(table.join(touched, partition, "left_semi").select(*table.columns), updates, keys, version)


def lookup(df: DataFrame, where: dict[str, object], order: list[Column | str], limit: int | None = None) -> DataFrame:
    """Rows with the given values, newest first or as ordered. The tests reach the scan; a limit keeps k rows per task."""
    for name, value in where.items():
        df = df.where(F.col(name) == value)
    df = df.orderBy(*order)
    return df if limit is None else df.limit(limit)


def merge_run_patch(runs: DataFrame, patches: DataFrame, key: str = "run_id", terminal: tuple[str, ...] = TERMINAL_RUN_STATUSES) -> DataFrame:
    """New status and merged metadata of runs; a terminal status sets the end time where none is set."""
    p = patches.select(key, F.col("status").alias("new_status"), F.col("at").alias("at_"), "meta_patch")
    rows = runs.join(p, key, "left")
    patch = F.coalesce("meta_patch", F.create_map().cast("map<string,string>"))
    kept = F.map_filter("meta", lambda k, v: ~F.array_contains(F.map_keys(patch), k))
    status = F.coalesce("new_status", "status")
    return rows.select(
        key, status.alias("status"), F.coalesce("ended_at", F.when(status.isin(*terminal), F.col("at_"))).alias("ended_at"), F.map_concat(kept, patch).alias("meta"),
    )


def migrate_annotations(df: DataFrame, text: str = "text", annotation: str = "annotation") -> DataFrame:
    """Markup strings become annotation documents; documents stay."""
    is_doc = F.col(annotation).startswith("{")
    old_spans = F.from_json(annotation, f"layers struct<spans:array<{SPAN_DDL}>>")["layers"]["spans"]
    spans = F.when(is_doc, old_spans).otherwise(mk.markup_to_spans(F.col(text), F.col(annotation)))
    return df.withColumn("spans_", spans).withColumn("doc", mk.annotation_doc(F.col(text), F.col("spans_"))).drop("spans_", annotation)


def merge_catalogs(existing: DataFrame, imported: DataFrame, key: str = "name") -> DataFrame:
    """All existing entries and the imported ones with a new name. Repeats inside the import are all kept."""
    return existing.unionByName(imported.join(existing.select(key), key, "left_anti"))


def replace_catalog(existing: DataFrame, imported: DataFrame) -> DataFrame:
    return imported.select(*existing.columns)


def import_preview(existing: DataFrame, imported: DataFrame, key: str = "name") -> DataFrame:
    n = F.count(F.lit(1))
    return one_row(
        imported.agg(n.alias("concept_count"), F.lit(0).alias("auto_fix_count")), imported.join(existing.select(key), key, "left_semi").agg(n.alias("duplicate_count")),
    )
