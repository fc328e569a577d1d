"""Comparison with gold spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import wording
from ..functions.core import half_even
from ..functions.markup import parse_markup
from ..functions.spans import f1_from_counts, span_difference, span_key, span_keys
from .ranking import top_k
from .stats import one_row


def span_prf(df: DataFrame, gold: str = "gold_spans", pred: str = "spans") -> DataFrame:
    """Adds precision, recall and f1 over (start, end, label); two empty sides give 0."""
    g, p = span_keys(F.col(gold), "metric"), span_keys(F.col(pred), "metric")
    df = df.withColumns({"tp_": F.size(F.array_intersect(g, p)), "ng_": F.size(g), "np_": F.size(p)})
    ratio = lambda n: F.when(F.col(n) > 0, F.col("tp_") / F.col(n)).otherwise(0.0)
    return df.withColumns({
        "precision": half_even(ratio("np_"), 4), "recall": half_even(ratio("ng_"), 4),
        "f1": f1_from_counts(F.col("tp_"), F.col("np_"), F.col("ng_"), "metric"),
    }).drop("tp_", "ng_", "np_")


def expand_gold_sets(gold_sets: DataFrame, tasks: DataFrame) -> DataFrame:
    """One row per listed task, in list order; a task that does not exist is a failed row, not a lost one."""
    listed = gold_sets.select("gold_set_id", F.posexplode("task_ids").alias("position", "task_id"))
    found = tasks.select(F.col("id").alias("task_id"), "text", "spans")
    out = listed.join(found, "task_id", "left")
    lost = F.col("text").isNull()
    return out.withColumns({"route": F.when(lost, "failed"), "reason": F.when(lost, wording.TASK_MISSING)})


def gold_compare(gold: DataFrame, predictions: DataFrame, key: str = "task_id") -> DataFrame:
    """Score, route (passed / unstable / failed), missing and extra spans of every prediction."""
    pairs = predictions.join(gold.select(key, F.col("spans").alias("gold_spans")), key)
    missing, extra = span_difference(F.col("gold_spans"), F.col("spans")), span_difference(F.col("spans"), F.col("gold_spans"))
    n_gold, n_pred = F.size(span_keys(F.col("gold_spans"), "gold")), F.size(span_keys(F.col("spans"), "gold"))
    rows = pairs.withColumns({"missing_spans": missing, "extra_spans": extra, "ng_": n_gold, "np_": n_pred})
    f1 = f1_from_counts(F.col("ng_") - F.size("missing_spans"), F.col("ng_"), F.col("np_"), "gold")
    rows = rows.withColumn("f1_", f1)
    same = (F.size("missing_spans") == 0) & (F.size("extra_spans") == 0)
    return rows.withColumns({
        "gold_score": half_even(F.col("f1_"), 4), "gold_route": F.when(same, "passed").when(F.col("f1_") >= 0.5, "unstable").otherwise("failed"),
    }).drop("f1_", "ng_", "np_")


def local_rule_predict(gold: DataFrame) -> DataFrame:
    """The baseline without a model: repeats the gold spans."""
    n = F.size("spans")
    score = F.when(n > 0, 1.0).otherwise(0.4)
    return gold.select(
        "*", score.alias("score"), F.when(score >= 0.9, "passed").otherwise("failed").alias("route"), F.lit("local-rule").alias("model"),
        F.to_json(F.struct(n.alias("span_count"))).alias("raw_response"),
    )


def concept_loss(compared: DataFrame, group: str = "candidate_id") -> DataFrame:
    """Weighted loss per candidate description from compared gold rows."""
    count = lambda r: F.count_if(F.col("gold_route") == r)
    agg = compared.select(group, "gold_route", F.size("missing_spans").alias("m"), F.size("extra_spans").alias("x"), F.round(F.col("gold_score") * 10000).cast("long").alias("u")).groupBy(group).agg(
        count("passed").alias("passed_count"), count("failed").alias("failed_count"), count("unstable").alias("unstable_count"),
        F.sum("m").alias("missing_count"), F.sum("x").alias("extra_count"), F.sum("u").alias("u"), F.count(F.lit(1)).alias("n"),
    )
    mean = F.col("u") / (F.col("n") * F.lit(10000.0))
    loss = F.col("failed_count") * 10.0 + F.col("unstable_count") * 5.0 + F.col("missing_count") * 1.5 + F.col("extra_count") * 1.0 + (F.lit(1.0) - mean) * 2.0
    return agg.withColumns({"loss": half_even(loss, 4), "mean_score": half_even(mean, 4)}).drop("u", "n")


def length_penalized(losses: DataFrame, current_length: Column, candidate_length: Column) -> DataFrame:
    """Adds the penalty for a longer description: 1 per 500 characters."""
    delta = candidate_length - current_length
    penalty = half_even(F.greatest(F.lit(0), delta) / 500.0, 4)
    return losses.withColumns({
        "raw_loss": half_even(F.col("loss"), 4), "length_delta": delta, "length_penalty": penalty, "loss": half_even(half_even(F.col("loss"), 4) + penalty, 4),
    })


def failure_summary(compared: DataFrame, group: str, key: str = "task_id", limit: int = 8, per_side: int = 3) -> DataFrame:
    """Text of the first failures of each group, by task id."""
    worst = top_k(compared.where(F.col("gold_route") != "passed"), [group], [key], limit)
    texts = lambda c, word: F.when(F.size(c) > 0, F.concat(F.lit(word), F.array_join(F.transform(F.slice(c, 1, per_side), lambda s: s["text"]), ", ")))
    parts = F.array_compact(F.array(texts("missing_spans", wording.MISSING_WORD), texts("extra_spans", wording.EXTRA_WORD)))
    line = F.concat(F.col(key), F.lit(": "), F.when(F.size(parts) > 0, F.array_join(parts, wording.PART_SEP)).otherwise(wording.UNSTABLE_WORD))
    lines = worst.select(group, "rank", line.alias("line")).groupBy(group).agg(F.array_sort(F.collect_list(F.struct("rank", "line"))).alias("ls"))  # at most `limit`
    found = lines.select(group, F.array_join(F.transform("ls", lambda x: x["line"]), "\n").alias("failure_summary"))
    return compared.select(group).distinct().join(found, group, "left").select(group, F.coalesce("failure_summary", F.lit(wording.ALL_PASSED)).alias("failure_summary"))


def failure_memory(versions: DataFrame, reviews: DataFrame, limit: int = 5) -> DataFrame:
    """Distinct failure notes: those of versions first (newest first), then those of hard or rejected reviews (newest first)."""
    v = versions.where(F.coalesce("failure_summary", F.lit("")) != "").select(
        F.lit(0).alias("source_rank"), F.col("created_at").cast("string").alias("at"), F.col("failure_summary").alias("note")
    )
    text = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("review_note", "error_type", "route_reason")])
    r = reviews.where(F.coalesce("hard_example", F.lit(False)) | (F.col("status") == "rejected")).select(
        F.lit(1).alias("source_rank"), F.col("created_at").cast("string").alias("at"), text.alias("note")
    )
    notes = v.unionByName(r).where(F.col("note").isNotNull()).groupBy("note").agg(
        F.min("source_rank").alias("source_rank"), F.max(F.struct(-F.col("source_rank"), "at")).alias("newest")
    )
    return notes.select("note", "source_rank", F.col("newest.at").alias("at")).orderBy("source_rank", F.desc("at"), "note").limit(limit)


def infer_labels(tasks: DataFrame, order: str = "id") -> DataFrame:
    """Distinct labels with the place they first appear; sorted by it. The result has one row per label."""
    spans = tasks.select(F.col(order).alias("at"), F.posexplode("spans").alias("pos", "s"))
    label = F.trim(F.col("s.label"))
    return (
        spans.select("at", "pos", label.alias("label")).where(F.col("label") != "").groupBy("label").agg(F.min(F.struct("at", "pos")).alias("first"))
        .select("label", F.col("first.at").alias("first_task"), F.col("first.pos").alias("first_position")).orderBy("first_task", "first_position")
    )


def markup_signature(markup: Column) -> Column:
    return F.array_sort(parse_markup(markup))


def audit_status(df: DataFrame, gold_markup: str = "gold_annotation", pred_markup: str = "annotation", has_issue: Column | None = None, warning: str = "warning", audit: bool = True) -> DataFrame:
    """conflict when the marked texts differ from gold, else review when anything is wrong, else accepted."""
    issue = F.col("issue_count") > 0 if has_issue is None else has_issue
    empty = F.coalesce(F.col(gold_markup), F.lit("")), F.coalesce(F.col(pred_markup), F.lit(""))
    differs = markup_signature(empty[0]) != markup_signature(empty[1]) if audit else F.lit(False)
    status = F.when(differs, "conflict").when(F.col(warning).isNotNull() | issue, "review").otherwise("accepted")
    return df.withColumn("status", status)


def experiment_metrics(reviews: DataFrame, tasks: DataFrame, compared: DataFrame) -> DataFrame:
    """One row of declared experiment rates over tasks, decided reviews and the comparison with gold."""
    share = lambda c: half_even(F.avg(c.cast("int")), 4)
    a = tasks.agg(share(F.col("route") == "review").alias("review_rate"))
    audited = (F.col("route_reason") == wording.ROUTE_REASON_AUDIT) & F.col("status").isin("accepted", "rejected")  # decided audits of sure tasks
    b = reviews.agg(
        share(F.coalesce((F.col("status") == "accepted") & ~F.col("manually_edited"), F.lit(False))).alias("candidate_accept_rate"),
        share(F.col("manually_edited")).alias("manual_rewrite_rate"),
        share(F.when(audited, (F.col("status") == "rejected") | F.col("manually_edited"))).alias("high_confidence_audit_error_rate"),
    )
    key = lambda c, fields: F.array_sort(F.array_distinct(F.transform(c, lambda s: F.concat_ws("\x1f", *[s[f].cast("string") for f in fields]))))
    c = compared.agg(
        share(key("spans", ["start", "end"]) == key("gold_spans", ["start", "end"])).alias("boundary_exact_match"),
        share(F.array_sort(span_keys(F.col("spans"), "metric")) == F.array_sort(span_keys(F.col("gold_spans"), "metric"))).alias("label_exact_match"),
    )
    return one_row(a, b, c)
