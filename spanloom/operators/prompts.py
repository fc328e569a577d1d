"""Prompt texts in bulk: joins and templating, no wording of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_LAYOUT = ["definition", "examples", "output_format", "text", "emphasis"]


def assemble_prompts(tasks: DataFrame, examples: DataFrame, definition: str, output_format: str, emphasis: str = "", max_examples: int = 5, key: str = "id") -> DataFrame:
    """Adds ``prompt``: definition, up to five numbered examples, format, text, emphasis; empty sections are left out.

    ``examples``: key, rank, text, annotation. Ranks beyond the limit never reach the aggregation.
    """
    few = examples.where(F.col("rank") <= max_examples).select(key, F.struct("rank", F.col("text").alias("t"), F.col("annotation").alias("a")).alias("x"))
    packed = few.groupBy(key).agg(F.array_sort(F.collect_list("x")).alias("xs"))
    shown = F.array_join(F.transform("xs", lambda x: F.concat(F.lit("Example "), x["rank"].cast("string"), F.lit(":\n"), x["t"], F.lit("\n=> "), x["a"])), "\n\n")
    parts = F.array(F.lit(definition), F.coalesce(shown, F.lit("")), F.lit(output_format), F.col("text"), F.lit(emphasis))
    prompt = F.array_join(F.filter(parts, lambda p: p != ""), "\n\n")
    return tasks.join(packed, key, "left").withColumn("prompt", prompt).withColumn("example_count", F.coalesce(F.size("xs"), F.lit(0))).drop("xs")
