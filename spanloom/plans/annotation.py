"""Batch annotation: context, prompts, k model samples per task, scores, routes and reviews, in one pass over tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.markup import spans_to_markup
from ..functions.vectors import hash_embed_udf
from ..operators.infer import Predictor, batch_infer, responses_to_predictions
from ..operators.prompts import assemble_prompts
from ..operators.retrieval import contrastive_select, cosine_scores
from ..operators.review import build_reviews, route_tasks
from ..session import checkpoint_dir


def annotation_context(tasks: DataFrame, pool: DataFrame, similar_k: int = 4, boundary_k: int = 2) -> DataFrame:
    """(id, role, rank, example_id, text, annotation, source_pool): nearest pool examples of every task and the farthest of the rest."""
    embed = hash_embed_udf()
    vectors = lambda df: df.select("id", embed(F.col("text")).alias("v"))
    picks = contrastive_select(vectors(tasks), vectors(pool), similar_k, boundary_k, score=cosine_scores)
    shown = pool.select(F.col("id").alias("example_id"), "text", spans_to_markup(F.col("spans")).alias("annotation"), "source_pool")
    return picks.join(shown, "example_id").select(F.col("query_id").alias("id"), "role", "rank", "example_id", "score", "text", "annotation", "source_pool")


def run_batch(
    tasks: DataFrame, pool: DataFrame, predict: Predictor, job_id: str, definition: str, output_format: str, k: int = 5, threshold: float = 0.75, audit_rate: float = 0.05,
) -> dict[str, DataFrame]:
    """Predictions, routed tasks and reviews of one job. The pool is a snapshot taken before the job, so results do not depend on timing.

    Responses are checkpointed: a model is not asked again because a later step needs its answers twice.
    """
    checkpoint_dir(tasks.sparkSession)
    context = annotation_context(tasks, pool).withColumn("rank", F.col("rank") + F.when(F.col("role") == "boundary", 100).otherwise(0))
    order = context.select("id", "text", "annotation", F.col("rank").alias("place"))
    ranked = order.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("place", "text", "annotation"))).alias("xs"))  # similar_k + boundary_k entries
    examples = ranked.select("id", F.posexplode("xs").alias("pos", "x")).select("id", (F.col("pos") + 1).alias("rank"), F.col("x.text").alias("text"), F.col("x.annotation").alias("annotation"))
    prompts = assemble_prompts(tasks, examples, definition, output_format).select(F.col("id").alias("task_id"), "text", "prompt")
    raw = batch_infer(prompts, predict, k).checkpoint()
    predictions = responses_to_predictions(raw, prompts)
    routed = route_tasks(predictions, job_id, threshold, audit_rate)
    return {"predictions": predictions, "routed": routed, "reviews": build_reviews(routed)}
