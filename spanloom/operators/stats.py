"""Dataset, token and run statistics."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import wording
from ..functions.core import half_even
from ..functions.places import token_roles
from ..functions.text import token_estimate

TOKENS = 1 << 18  # tokens that are counted at once


def one_row(*frames: DataFrame) -> DataFrame:
    """Put one-row aggregates side by side: a union with missing columns, then the only value of each column."""
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


def _rate(cond: Column, digits: int = 4) -> Column:
    n = F.count(F.lit(1))
    return half_even(F.when(n > 0, F.count_if(cond) / n).otherwise(0.0), digits)


def dataset_figures(tasks: DataFrame, predictions: DataFrame, reviews: DataFrame, jobs: DataFrame) -> DataFrame:
    """All figures of the dataset report in one pass over each table: a row of kind ``all``, and one per ``route`` and per ``label``.

    A task is one row per span (one row without spans) of which the first stands for the task; grouping sets count the whole, the
    routes and the labels together.
    """
    route = F.coalesce("route", F.lit(wording.NO_ROUTE))
    rows = tasks.select(route.alias("route"), "hard_example", "promote_to_gold", "agreement", F.posexplode_outer("spans").alias("place", "s"))
    rows = rows.select(
        "route", F.when(F.col("s").isNotNull(), F.coalesce("s.label", F.lit(wording.NO_LABEL))).alias("label"), (F.coalesce("place", F.lit(0)) == 0).alias("is_task"), "s",
        "hard_example", "promote_to_gold", "agreement")
    # One row that is no task and has no span, so that empty tables have a whole, too; it falls into no route and no label.
    rows = rows.unionByName(tasks.sparkSession.range(1).select(F.lit(False).alias("is_task")), allowMissingColumns=True)
    task, located = F.col("is_task"), (F.col("s.start") >= 0) & (F.col("s.end") > F.col("s.start"))
    n = F.count_if(task)
    share = lambda cond: half_even(F.when(n > 0, F.count_if(task & cond) / n).otherwise(0.0), 4)
    agreement = F.when(task, F.round(F.col("agreement") * 10000).cast("long"))
    sets = rows.groupingSets([[], ["route"], ["label"]], "route", "label").agg(
        F.grouping("route").alias("no_route"), F.grouping("label").alias("no_label"), F.count("s").alias("span_count"), n.alias("task_count"),
        share(F.col("route") == "auto_accept").alias("auto_accept_rate"), share(F.col("route") == "review").alias("review_rate"),
        F.count_if(task & F.col("hard_example")).alias("hard_example_count"), F.count_if(task & F.col("promote_to_gold")).alias("promoted_to_gold_count"),
        half_even(F.coalesce(F.sum(agreement) / (F.count(agreement) * F.lit(10000.0)), F.lit(0.0)), 4).alias("avg_agreement"),
        F.count_if(task & (F.col("agreement") < 0.6)).alias("low_consistency_count"),
        half_even(F.coalesce(F.try_divide(F.sum(F.when(located, F.col("s.end") - F.col("s.start"))), F.count_if(located)), F.lit(0.0)), 2).alias("avg_span_length"),
    )
    kind = F.when(F.col("no_route") == 0, "route").when(F.col("no_label") == 0, "label").otherwise("all")
    figures = sets.withColumn("kind", kind).withColumn("name", F.coalesce("route", "label")).where("kind = 'all' OR name IS NOT NULL").drop("no_route", "no_label", "route", "label")
    r = reviews.agg(
        F.count(F.lit(1)).alias("review_count"), F.count_if(F.col("status") == "pending").alias("pending_review_count"),
        F.count_if(F.col("status") == "accepted").alias("accepted_review_count"), F.count_if("manually_edited").alias("manual_edit_count"),
    )
    others = one_row(predictions.agg(F.count(F.lit(1)).alias("prediction_count")), r, jobs.agg(F.count(F.lit(1)).alias("job_count")))
    return figures.join(F.broadcast(others))  # one-row side


STATS = [
    "task_count", "prediction_count", "review_count", "pending_review_count", "accepted_review_count", "job_count", "auto_accept_rate", "review_rate", "hard_example_count",
    "manual_edit_count", "promoted_to_gold_count", "avg_agreement", "low_consistency_count", "avg_span_length",
]


def dataset_stats(tasks: DataFrame, predictions: DataFrame, reviews: DataFrame, jobs: DataFrame) -> DataFrame:
    """One row of counts and rates over the four tables, each scanned once."""
    return dataset_figures(tasks, predictions, reviews, jobs).where("kind = 'all'").select(*STATS)


def dataset_stats_by(tasks: DataFrame, *by: str) -> DataFrame:
    """Task counts and auto rate for each subtotal of the given columns (convenience over ``rollup``)."""
    return tasks.rollup(*by).agg(F.count(F.lit(1)).alias("task_count"), _rate(F.col("route") == "auto_accept").alias("auto_accept_rate"))


def label_distribution(tasks: DataFrame) -> DataFrame:
    return tasks.select(F.explode("spans").alias("s")).groupBy(F.coalesce("s.label", F.lit(wording.NO_LABEL)).alias("label")).agg(F.count(F.lit(1)).alias("span_count"))


def route_distribution(tasks: DataFrame) -> DataFrame:
    return tasks.groupBy(F.coalesce("route", F.lit(wording.NO_ROUTE)).alias("route")).agg(F.count(F.lit(1)).alias("task_count"))


def document_label_counts(tasks: DataFrame, key: str = "id") -> DataFrame:
    """Per task and label: spans and implied spans. Counted inside the row, so nothing is shuffled."""
    labels = F.array_distinct(F.transform("spans", lambda s: s["label"]))
    rows = tasks.select(key, "spans", F.explode(labels).alias("label"))
    own = lambda s: s["label"] == F.col("label")
    return rows.select(
        key, "label", F.size(F.filter("spans", own)).alias("span_count"), F.size(F.filter("spans", lambda s: own(s) & s["implicit"])).alias("implicit_count")
    )


def agreement_histogram(tasks: DataFrame, column: str = "agreement") -> DataFrame:
    v = F.coalesce(F.col(column), F.lit(0.0))
    return tasks.groupBy((F.floor(v * 10) / 10.0).alias("bucket")).agg(F.count(F.lit(1)).alias("task_count"))


def token_label_stats(samples: DataFrame, key: str = "id", window: int = 2) -> DataFrame:
    """Entity, context (within ``window`` tokens of an entity) and other counts and probabilities per token.

    Texts are dealt by key and tokens marked inside their row: no token is shuffled or sorted, only counts of the tokens of a batch leave it.
    Rows of one key count as one text.
    """
    starts, ends = (F.transform(F.filter("spans", lambda s: ~s["implicit"]), lambda s: s[f]) for f in ("start", "end"))
    rows = samples.where("text IS NOT NULL AND spans IS NOT NULL").select(key, F.struct("text", starts.alias("starts"), ends.alias("ends")).alias("x"))
    rows = rows.groupBy(key).agg(F.collect_list("x").alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted(tokens: list[str], roles: list[np.ndarray]) -> pa.RecordBatch:
            coded = pa.array(tokens, pa.string()).dictionary_encode()
            codes, role, n = coded.indices.to_numpy(), np.concatenate(roles), len(coded.dictionary)
            return pa.record_batch([coded.dictionary, *[pa.array(np.bincount(codes[role == r], minlength=n), pa.int64()) for r in range(3)]], names=["token", "e", "c", "o"])

        for batch in batches:
            tokens, roles = [], []
            for parts in batch.column(0):
                words, role = token_roles(parts.as_py(), window)
                tokens += words
                roles.append(role)
                if len(tokens) > TOKENS:
                    yield counted(tokens, roles)
                    tokens, roles = [], []
            if tokens:
                yield counted(tokens, roles)

    counts = rows.select("parts").mapInArrow(run, "token string, e long, c long, o long").groupBy("token").agg(
        F.sum("e").alias("entity_count"), F.sum("c").alias("context_count"), F.sum("o").alias("other_count"), F.sum(F.col("e") + F.col("c") + F.col("o")).alias("total"),
    )
    return counts.select("*", *[(F.col(f"{r}_count") / F.col("total")).alias(f"{r}_p") for r in ("entity", "context", "other")])


def token_stats_report(stats: DataFrame) -> DataFrame:
    return stats.select(
        "token", "entity_count", "context_count", "other_count", "total",
        *[half_even(F.col(f"{r}_p"), 4).alias(f"{r}_probability") for r in ("entity", "context", "other")],
    )


def top_entity_tokens(stats: DataFrame, k: int = 10) -> DataFrame:
    return stats.orderBy(F.desc("entity_count"), F.desc("entity_p"), F.desc("token")).limit(k)


def review_feedback_counts(reviews: DataFrame) -> DataFrame:
    return reviews.where(F.coalesce("error_type", F.lit("")) != "").groupBy("error_type").agg(F.count(F.lit(1)).alias("review_count"))


def version_report(versions: DataFrame) -> DataFrame:
    return versions.select(
        "version", "pass_count", F.size("failed_task_ids").alias("failed"), F.size("unstable_task_ids").alias("unstable"), "round_index"
    ).orderBy("version")


def reflection_item_counts(items: DataFrame) -> DataFrame:
    return items.groupBy("item_type").agg(F.count(F.lit(1)).alias("item_count")).orderBy("item_type")


def route_counts(scores: DataFrame) -> DataFrame:
    """Counts for high, medium and low in that order, zeros included."""
    spark = scores.sparkSession
    fixed = spark.createDataFrame([(0, "high"), (1, "medium"), (2, "low")], "position int, route string")
    found = scores.groupBy("route").agg(F.count(F.lit(1)).alias("n"))
    return fixed.join(found, "route", "left").select("position", "route", F.coalesce("n", F.lit(0)).alias("sample_count")).orderBy("position")


JUDGE_METRICS = ["brief_alignment", "style_fit", "clarity", "scientific_tone", "usefulness"]


def normal_score(raw: Column) -> Column:
    """A judge score as a number from 1 to 5 with two places; 3 when it is not a number."""
    return F.least(F.lit(5.0), F.greatest(F.lit(1.0), half_even(F.coalesce(raw.try_cast("double"), F.lit(3.0)), 2)))


def judge_averages(items: DataFrame, metrics: list[str] = JUDGE_METRICS) -> DataFrame:
    cents = lambda m: F.sum(F.round(normal_score(F.col(m)) * 100).cast("long"))
    return items.agg(*[half_even(cents(m) / (F.count(F.lit(1)) * F.lit(100.0)), 2).alias(m) for m in metrics])


def usage_summary(calls: DataFrame, *by: str) -> DataFrame:
    """Calls, tokens and elapsed seconds of model calls, per group."""
    return calls.groupBy(*by).agg(
        F.count_if("is_call").alias("llm_call_count"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"),
        F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("total_tokens"), F.max("elapsed_seconds").alias("provider_elapsed_seconds"),
    )


def conversation_calls(turns: DataFrame) -> DataFrame:
    """Turns as model calls: an assistant turn is a call, its text the completion; every other text is prompt."""
    own = F.col("role") == "assistant"
    n = token_estimate(F.col("text")).cast("long")
    return turns.select(
        "*", own.alias("is_call"), F.when(own, 0).otherwise(n).alias("prompt_tokens"), F.when(own, n).otherwise(0).alias("completion_tokens"), F.lit(0.0).alias("elapsed_seconds")
    )


def method_trace_summary(candidates: DataFrame) -> DataFrame:
    """Trace counts and extreme mask deltas per method."""
    set_ = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) != ""
    return candidates.groupBy("method").agg(
        F.count_if("accepted").alias("accepted_candidate_count"), F.count_if(set_("critic_diagnosis")).alias("critic_trace_count"),
        F.count_if(set_("controller_direction")).alias("controller_trace_count"), F.count_if(set_("mask_segment_id")).alias("mask_trace_count"),
        F.coalesce(F.max("mask_loss_delta"), F.lit(0.0)).alias("max_mask_loss_delta"), F.coalesce(F.min("mask_loss_delta"), F.lit(0.0)).alias("min_mask_loss_delta"),
    )


def repair_summary(candidates: DataFrame, *by: str) -> DataFrame:
    tried = F.col("repair_attempts") > 0
    return candidates.groupBy(*by).agg(
        F.sum("repair_attempts").alias("repair_attempt_count"), F.count_if(tried & F.col("memorization_passed")).alias("repair_success_count"),
        F.count_if(F.col("status") == "memorization_repair_failed").alias("repair_failed_count"),
    )


def home_metrics(concepts: DataFrame, history: DataFrame) -> DataFrame:
    a = concepts.agg(F.count(F.lit(1)).alias("concept_count"), F.count_if(~F.coalesce("is_default", F.lit(False))).alias("custom_count"))
    n = F.length(F.coalesce("annotation", F.lit("")))
    return one_row(a, history.agg(F.count(F.lit(1)).alias("history_count"), F.coalesce(F.sum(n) / F.count(F.lit(1)), F.lit(0.0)).alias("avg_length")))


def run_manifest(run_name: str, **tables: DataFrame) -> DataFrame:
    """(run_name, metric, value): the row count of each table, in one job."""
    counts = [df.agg(F.count(F.lit(1)).alias("value")).select(F.lit(run_name).alias("run_name"), F.lit(f"{name}_count").alias("metric"), "value") for name, df in tables.items()]
    return reduce(DataFrame.unionByName, counts)


def status_counts(records: DataFrame, statuses: tuple[str, ...] = ("accepted", "review", "conflict")) -> DataFrame:
    return records.agg(F.count(F.lit(1)).alias("sample_count"), *[F.count_if(F.col("status") == s).alias(f"{s}_count") for s in statuses])
