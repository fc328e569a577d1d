"""Corpus preparation: seeds to chunks, memory records, a vector index and a plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.vectors import hash_embed_udf
from ..operators.corpus import chunk_documents, focus_pool, memory_records, plan_tasks
from ..operators.joins import pending_tasks
from ..operators.retrieval import search
from ..operators.dedup import greedy_dedup
from ..operators.validate import judge_items
from ..sources.generations import append_generation, last_commit, read_state


def prepare(seeds: DataFrame, chunk_size: int = 520, overlap: int = 80) -> DataFrame:
    """Memory records of all chunks of the seed documents."""
    return memory_records(chunk_documents(seeds.where("error IS NULL").drop("error"), chunk_size, overlap))


def index_texts(records: DataFrame) -> DataFrame:
    """(id, v): one vector per record over title, summary, key points and terms."""
    parts = [F.col("title"), F.col("summary"), F.array_join("canonical_points", "\n"), F.array_join("terminology", " ")]
    text = F.array_join(F.filter(F.array(*parts), lambda p: F.trim(p) != ""), "\n")
    return records.select(F.col("chunk_id").alias("id"), hash_embed_udf()(text).alias("v"))


def plan(records: DataFrame, genres: DataFrame, name: str, total_samples: int, samples_per_task: int, domain: str, language: str) -> DataFrame:
    return plan_tasks(genres, focus_pool(records), name, total_samples, samples_per_task, domain, language)


def recall(tasks: DataFrame, index: DataFrame, k: int = 4) -> DataFrame:
    """(task_id, chunk_id, score, rank): the index entries nearest to each task's query."""
    queries = tasks.select(F.col("task_id").alias("id"), hash_embed_udf()(F.col("query")).alias("v"))
    return search(queries, index, k, round_to=None, drop_self=False).select(F.col("query_id").alias("task_id"), F.col("example_id").alias("chunk_id"), "score", "rank")


def finished(spark: SparkSession, target: str, schema: StructType) -> DataFrame:
    """(task_id, items) of all tasks that a commit covers. The rows are ledger and results at once, so neither can be there without the other."""
    return read_state(spark, target, schema)


def generate(tasks: DataFrame, work: Callable[[DataFrame, DataFrame], DataFrame], target: str, parts: int = 4, stop_after: int | None = None) -> DataFrame:
    """Runs a plan part by part, each part one commit, and leaves out what earlier commits cover; gives (task_id, items) of what is finished.

    ``tasks`` has task_id and task_index. ``work(tasks, items so far)`` gives the items of tasks with task_id; a task without items is
    finished too. A run that ends between commits, or in one, goes on from the last whole commit. ``stop_after`` ends it after so many.
    """
    spark = tasks.sparkSession
    kind = tasks.schema["task_id"].dataType.simpleString()
    none = spark.createDataFrame([], f"task_id {kind}")
    schema, made = None, 0
    for part in range(parts):
        todo = tasks.where(F.pmod("task_index", F.lit(parts)) == part)
        gen = last_commit(spark, target) + 1
        if schema is None:
            item = work(todo.limit(0), none).schema
            columns = [f"`{f.name}`: {f.dataType.simpleString()}" for f in item if f.name != "task_id"]
            schema = spark.createDataFrame([], f"task_id {kind}, items array<struct<{', '.join(columns)}>>").schema
        done = finished(spark, target, schema)
        todo = pending_tasks(todo, done).checkpoint()
        if stop_after is not None and made >= stop_after or not todo.limit(1).count():
            continue
        items = work(todo, done.select("task_id", F.inline("items")))
        names = [f.name for f in schema["items"].dataType.elementType]
        lists = items.groupBy("task_id").agg(F.collect_list(F.struct(*names)).alias("items"))  # a task has few items
        rows = todo.select("task_id").join(lists, "task_id", "left").withColumn("items", F.coalesce("items", F.array().cast(schema["items"].dataType)))
        append_generation(rows, target, gen)
        made += 1
    return finished(spark, target, schema)


def judge(items: DataFrame, language: str, domain: str, banned: list[str], limit: float = 0.92) -> DataFrame:
    """Rule judgement plus duplicate check. Items the rules refuse never count as accepted, so they are left out of the comparison."""
    ruled = judge_items(items, language, domain, banned)
    body = F.concat_ws("\n", "prompt", "response")
    unique = greedy_dedup(ruled.where("status = 'accepted'").select("id", F.col("task_id").alias("task"), "at", body.alias("text")), limit)
    out = ruled.join(unique.select("id", "accepted"), "id", "left")
    twice = F.coalesce(~F.col("accepted"), F.lit(False))
    return out.withColumns({
        "issues": F.when(twice, F.array_append("issues", F.lit("duplicate"))).otherwise(F.col("issues")), "status": F.when(twice, "review").otherwise(F.col("status")),
    }).drop("accepted")
