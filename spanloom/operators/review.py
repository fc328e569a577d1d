"""Routing, review queues and review decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import wording
from ..functions.core import half_even
from ..functions.markup import spans_to_markup
from .agreement import consensus_scores
from .ranking import rank_in_group, top_k

ROUTE_BASE = {"low": 100, "medium": 50, "high": 10}


def audit_sample(job: Column, task: Column, rate: float) -> Column:
    """Deterministic share of tasks that are reviewed although their score is high."""
    digest = F.sha1(F.concat(job, F.lit(":"), task))
    return (F.lit(rate) > 0) & (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967295.0) < F.lit(rate))


def best_predictions(predictions: DataFrame, key: str = "task_id", order: str = "run") -> DataFrame:
    """Highest score per task, the first one on ties; a missing score counts as 0."""
    rank = F.struct(F.coalesce("score", F.lit(0.0)).alias("s"), (-F.col(order)).alias("o"))
    return predictions.groupBy(key).agg(F.max_by("prediction_id", rank).alias("best_prediction_id"))


def route_tasks(predictions: DataFrame, job_id: str, threshold: float = 0.75, audit_rate: float = 0.05, key: str = "task_id", scores: DataFrame | None = None) -> DataFrame:
    scores = consensus_scores(predictions, key, with_best=True) if scores is None else scores.join(best_predictions(predictions, key), key)
    audit = audit_sample(F.lit(job_id), F.col(key), audit_rate)
    sure = F.col("score") >= threshold
    auto = sure & ~audit
    return scores.select(
        key, F.lit(job_id).alias("job_id"), "score", "agreement", "exact_match_rate", "avg_confidence", F.col("avg_rule_risk").alias("rule_risk"),
        F.when(auto, "auto_accept").otherwise("review").alias("route"),
        F.when(audit & sure, wording.ROUTE_REASON_AUDIT).otherwise(wording.ROUTE_REASON_SCORE).alias("route_reason"),
        F.when(auto, "auto").otherwise("review").alias("source_pool"), F.when(auto, "accept").alias("answer"), "best_prediction_id",
    )


def build_reviews(routed: DataFrame, key: str = "task_id", created_at: Column | None = None) -> DataFrame:
    """One pending review per task on the review route. Its predictions are found by (task, run), not listed."""
    created = F.lit(None).cast("timestamp") if created_at is None else created_at
    return routed.where(F.col("route") == "review").select(
        F.concat(F.lit("review-"), F.col(key)).alias("review_id"), key, "job_id", F.lit("pending").alias("status"), "score", "agreement",
        "exact_match_rate", "avg_confidence", "rule_risk", "route_reason", created.alias("created_at"),
    )


def option_text(spans: Column) -> Column:
    text = F.array_join(F.transform(spans, lambda s: F.concat(s["text"], F.lit(" / "), s["label"])), "; ")
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(wording.OPTION_EMPTY))


def lettered(predictions: DataFrame, key: str = "task_id", order: str = "run", limit: int = 26) -> DataFrame:
    """The first predictions of each task with their rank, which is what option letters stand for."""
    return top_k(predictions, [key], [order, "prediction_id"], limit)


def review_options(reviews: DataFrame, predictions: DataFrame, key: str = "task_id", order: str = "run", limit: int = 5) -> DataFrame:
    """Lettered options of each review (the first ``limit`` predictions) and the manual option."""
    mine = lettered(predictions.join(reviews.select(key), key, "left_semi"), key, order, limit)
    first = mine.join(reviews.select(key, "review_id"), key).select(
        "review_id", F.col("rank").alias("position"), F.char(64 + F.col("rank")).alias("option_id"), option_text(F.col("spans")).alias("text"),
    )
    manual = reviews.select("review_id", F.lit(limit + 1).alias("position"), F.lit("manual").alias("option_id"), F.lit(wording.OPTION_MANUAL).alias("text"))
    return first.unionByName(manual)


def review_priority(route: Column, uncertainty: Column) -> Column:
    base = F.lit(0)
    for name, value in ROUTE_BASE.items():
        base = F.when(route == name, value).otherwise(base)
    return (base + half_even(uncertainty * 10, 0).cast("int")).cast("int")


def human_review_queue(candidates: DataFrame, scores: DataFrame, routes: tuple[str, ...] = ("medium", "low"), key: str = "sample_id") -> DataFrame:
    """Review options in queue order: priority down, sample id, option. Options are lettered by candidate id."""
    waiting = scores.where(F.col("route").isin(*routes)).select(
        key, "route", "pairwise_span_f1", "exact_match_rate", review_priority(F.col("route"), F.col("uncertainty_score")).alias("priority")
    )
    options = candidates.select(key, "candidate_id", "spans", "model_confidence").join(waiting, key)
    ranked = rank_in_group(options, [key], ["candidate_id"], "position")
    return ranked.select(
        key, "route", "priority", "pairwise_span_f1", "exact_match_rate", F.char(64 + F.col("position")).alias("option_id"), "position", "candidate_id",
        spans_to_markup(F.col("spans")).alias("annotation_markup"), "model_confidence",
    ).orderBy(F.desc("priority"), key, "position")


def review_queue(reviews: DataFrame, threshold: float = 0.75, include_audit: bool = True, job_id: str | None = None, limit: int = 200) -> DataFrame:
    """Pending reviews with a low score, and audited ones; weakest first."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    due = zero("score") <= threshold
    if include_audit:
        due = due | (F.col("route_reason") == wording.ROUTE_REASON_AUDIT)
    out = reviews.where((F.col("status") == "pending") & due)
    if job_id:
        out = out.where(F.col("job_id") == job_id)
    return out.orderBy(zero("score"), zero("agreement"), zero("avg_confidence"), "created_at", "review_id").limit(limit)


def review_bundle(reviews: DataFrame, tasks: DataFrame, predictions: DataFrame, jobs: DataFrame, guidelines: DataFrame, gold_sets: DataFrame, gold_k: int = 3) -> DataFrame:
    """Everything a reviewer needs, one row per review and prediction: task text, guideline, first gold examples."""
    newest = top_k(gold_sets, ["guideline_id"], [F.desc("created_at"), F.desc("gold_set_id")], 1).drop("rank")
    listed = newest.select("guideline_id", F.posexplode(F.slice("task_ids", 1, gold_k)).alias("pos", "gold_id"))
    known = listed.join(tasks.select(F.col("id").alias("gold_id")), "gold_id")
    examples = known.groupBy("guideline_id").agg(F.array_sort(F.collect_list(F.struct("pos", "gold_id"))).alias("g"))  # at most gold_k
    examples = examples.select("guideline_id", F.transform("g", lambda x: x["gold_id"]).alias("gold_examples"))
    context = jobs.select("job_id", "guideline_id").join(guidelines.select("guideline_id", "name"), "guideline_id", "left").join(examples, "guideline_id", "left")
    return (
        reviews.join(context, "job_id", "left")
        .join(tasks.select(F.col("id").alias("task_id"), "text"), "task_id", "left")
        .join(predictions.select("task_id", "prediction_id", "run", "spans"), "task_id", "left")
    )


def apply_decisions(reviews: DataFrame, decisions: DataFrame, tasks: DataFrame, predictions: DataFrame, order: str = "run") -> DataFrame:
    """One row per decided review: its new state, and the new state of its task (``task_answer`` is NULL for a skip).

    The option letter names the rank of a prediction of its task, as ``review_options`` shows it, so the chosen spans come from an
    equi-join on (task, rank); only predictions of decided tasks are ranked. ``error`` is set for a letter without a prediction and for
    a decision on a review or task that is not there, which changes nothing.
    """
    r = reviews.select("review_id", "task_id", F.coalesce("hard_example", F.lit(False)).alias("was_hard"))
    t = tasks.select(F.col("id").alias("task_id"), F.col("spans").alias("task_spans"), F.col("source_pool").alias("old_pool"))
    option, decision = F.col("selected_option_id"), F.col("decision")
    kind = (
        F.when(decision == "skip", "skip").when(decision == "reject", "reject")
        .when((decision == "manual") | F.coalesce(option == "manual", F.lit(False)), "manual").otherwise("accept")
    )
    letter = F.coalesce(option, F.lit("A"))
    rows = decisions.join(r.withColumn("known", F.lit(True)), "review_id", "left").withColumn("kind", kind)
    rows = rows.withColumn("choice", F.when(F.col("kind") == "accept", (F.ascii(F.upper(letter)) - 64).cast("long")))
    decided = predictions.join(rows.where("kind = 'accept'").select("task_id").distinct(), "task_id", "left_semi")
    p = lettered(decided, "task_id", order).select("task_id", F.col("rank").cast("long").alias("choice"), F.col("prediction_id").alias("chosen_id"), F.col("spans").alias("chosen_spans"))
    rows = rows.join(t.withColumn("has_task", F.lit(True)), "task_id", "left").join(p, ["task_id", "choice"], "left")
    kind = F.col("kind")
    by = lambda skip, reject, manual, accept: F.when(kind == "skip", skip).when(kind == "reject", reject).when(kind == "manual", manual).otherwise(accept)
    null = F.lit(None).cast("string")
    no = F.lit(False)
    hard, err = F.coalesce("hard_example", no), F.coalesce("error_type", F.lit(""))
    reject_err = F.coalesce(F.nullif(err, F.lit("")), F.lit("all_candidates_wrong"))
    promote = by(no, no, F.coalesce("promote_to_gold", no), F.coalesce("promote_to_gold", no))
    out = rows.select(
        "review_id", "task_id",
        by(F.lit("ignored"), F.lit("rejected"), F.lit("accepted"), F.lit("accepted")).alias("status"),
        by(F.lit("skip"), F.coalesce(option, F.lit("reject")), F.lit("manual"), letter).alias("answer"),
        by(null, F.coalesce(option, F.lit("reject")), F.lit("manual"), F.col("chosen_id")).alias("selected_candidate_id"),
        by(no, no, F.lit(True), no).alias("manually_edited"),
        by(hard, hard | F.coalesce("was_hard", no), hard, hard).alias("review_hard_example"),
        by(err, reject_err, err, err).alias("error_type"), promote.alias("promote_to_gold"), F.coalesce("note", F.lit("")).alias("review_note"),
        by(null, F.lit("reject"), F.lit("accept"), F.lit("accept")).alias("task_answer"),
        by(F.col("task_spans"), F.col("task_spans"), F.col("manual_spans"), F.col("chosen_spans")).alias("task_spans"),
        by(F.col("old_pool"), F.coalesce("old_pool", F.lit("reviewed")), F.when(promote, "gold_like").otherwise(F.coalesce("old_pool", F.lit("reviewed"))),
           F.when(promote, "gold_like").otherwise(F.coalesce("old_pool", F.lit("reviewed")))).alias("task_source_pool"),
        by(no, hard, hard, hard).alias("task_hard_example"),
        F.when(F.col("known").isNull(), "unknown_review").when(F.col("has_task").isNull(), "unknown_task")
        .when((kind == "accept") & F.col("chosen_id").isNull(), "invalid_option").alias("error"),
    )
    lost = F.coalesce(F.col("error").startswith("unknown_"), F.lit(False))
    return out.select("review_id", *[F.when(~lost, F.col(c)).alias(c) for c in out.columns if c not in ("review_id", "error")], "error")
