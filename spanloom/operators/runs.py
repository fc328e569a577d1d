"""Run analytics: ordered computations over run events and candidate evaluations.

Running values are computed in two levels. Events of a run are cut into time buckets, and buckets into blocks of bounded row count by
their place in the order of all events; a block is a window partition, and what came before it is added from a small table with one
row per run and block. A run, or one hour of it, that holds a large share of all events is thus spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.core import half_even
from ..session import checkpoint_dir
from ..sources.positions import with_position

BUCKET = "hour"
BLOCK_ROWS = 65_536


def _blocks(rows: DataFrame, full: DataFrame, key: str, ts: str, tie: str, block_rows: int) -> DataFrame:
    """Adds ``block_``: 0 in buckets of few rows, else the place in the order of all rows of full buckets by blocks of bounded size."""
    if not full.limit(1).count():
        return rows.withColumn("block_", F.lit(0).cast("long"))
    same = (F.col(key) == F.col("k_")) & (F.col("b_") == F.col("t_"))
    few = rows.join(full, same, "left_anti").withColumn("block_", F.lit(0).cast("long"))
    many = with_position(rows.join(full, same, "left_semi"), [key, ts, tie], "place_")
    return few.unionByName(many.withColumn("block_", F.floor((F.col("place_") - 1) / block_rows)).drop("place_"))


def running(events: DataFrame, key: str, ts: str, tie: str, values: dict[str, tuple[str, Column]], bucket: str = BUCKET, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Adds running sum/max/min/count columns up to and including each event: ``{name: (kind, column)}``."""
    checkpoint_dir(events.sparkSession)
    # Blocks are cut where more than one would do: a (key, bucket) of few rows stays one, without a sort.
    rows = events.withColumn("b_", F.date_trunc(bucket, ts))
    full = rows.groupBy(key, "b_").agg(F.count(F.lit(1)).alias("n_")).where(F.col("n_") > block_rows).select(F.col(key).alias("k_"), F.col("b_").alias("t_")).checkpoint()
    rows = _blocks(rows, full, key, ts, tie, block_rows)
    fn = {"sum": F.sum, "max": F.max, "min": F.min, "count": F.count}
    merge = {"sum": F.sum, "max": F.max, "min": F.min, "count": F.sum}
    per = rows.groupBy(key, "b_", "block_").agg(*[fn[kind](col).alias(f"{n}_p") for n, (kind, col) in values.items()])
    before = W.partitionBy(key).orderBy("b_", "block_").rowsBetween(W.unboundedPreceding, -1)
    carried = per.select(key, "b_", "block_", *[merge[kind](f"{n}_p").over(before).alias(f"{n}_b") for n, (kind, _) in values.items()])
    inside = W.partitionBy(key, "b_", "block_").orderBy(ts, tie).rowsBetween(W.unboundedPreceding, W.currentRow)
    local = rows.select("*", *[fn[kind](col).over(inside).alias(f"{n}_l") for n, (kind, col) in values.items()])
    out = local.join(carried, [key, "b_", "block_"])
    total = {
        "sum": lambda b, l: F.coalesce(b, F.lit(0)) + F.coalesce(l, F.lit(0)), "count": lambda b, l: F.coalesce(b, F.lit(0)) + l,
        "max": lambda b, l: F.greatest(b, l), "min": lambda b, l: F.least(b, l),
    }
    return out.select(*events.columns, *[total[kind](F.col(f"{n}_b"), F.col(f"{n}_l")).alias(n) for n, (kind, _) in values.items()])


def progress_eta(events: DataFrame, totals: DataFrame, key: str = "run_id", bucket: str = BUCKET, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Completed calls, failures, progress, elapsed seconds and ETA after every event. ``totals``: key, total."""
    done = (F.col("event_type") == "call_succeeded").cast("long")
    failed = (F.col("event_type") == "call_failed").cast("long")
    rows = running(events, key, "ts", "event_id", {"completed": ("sum", done), "failed": ("sum", failed), "started_at": ("min", F.col("ts"))}, bucket, block_rows)
    rows = rows.join(totals, key)
    done, total = F.col("completed"), F.col("total")
    elapsed = F.unix_micros("ts") / 1e6 - F.unix_micros("started_at") / 1e6
    progress = F.when(F.col("event_type").isin("run_completed", "outputs_written"), 1.0).when(total <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(done / total, F.lit(0.99))))
    eta = F.when((done > 0) & (total > 0) & (done < total), half_even(elapsed / done * (total - done), 2))
    return rows.withColumns({"progress": progress, "elapsed_seconds": half_even(elapsed, 2), "eta_seconds": eta}).drop("started_at")


def running_best(events: DataFrame, key: str = "run_id", bucket: str = BUCKET, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Best pass count, best loss, tokens and retries so far, after every event."""
    return running(events, key, "ts", "event_id", {
        "best_pass_count": ("max", F.col("pass_count")), "best_loss": ("min", F.col("loss")), "total_tokens": ("sum", F.col("tokens")),
        "retry_count": ("sum", (F.col("event_type") == "call_retried").cast("long")),
    }, bucket, block_rows)


def latest_per_key(df: DataFrame, keys: list[str], at: list[str]) -> DataFrame:
    """The newest row per key, as an aggregate with partial results."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*at)).alias("r")).select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def next_version(versions: DataFrame, key: str = "guideline_id") -> DataFrame:
    return versions.groupBy(key).agg((F.coalesce(F.max("version"), F.lit(0)) + 1).alias("next_version"))


def best_candidates(evaluations: DataFrame, group: list[str], start_loss: float, min_delta: float = 0.0) -> DataFrame:
    """The accepted candidate of each round, in evaluation order: accepted when loss + min_delta is below the loss selected so far.

    Evaluations of one description after the first are skipped. Rows: group, evaluation_index, description, loss, candidate_id. The fold is
    sequential by definition; it only has to see candidates that lower the running minimum, so others are dropped before the
    list is built: within a round that leaves few rows whatever its size.
    """
    first = evaluations.groupBy(*group, "description").agg(F.min(F.struct("evaluation_index", "candidate_id", "loss")).alias("x"))
    rows = first.select(*group, "x.*")
    # A row that is not a strict new minimum of its slice can never be accepted, so each slice is cut down to its record lows first.
    slice_ = F.floor(F.col("evaluation_index") / 1024)
    low = W.partitionBy(*group, "slice_").orderBy("evaluation_index").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("slice_", slice_).withColumn("seen", F.min("loss").over(low)).where(F.col("seen").isNull() | (F.col("loss") < F.col("seen")))
    lists = rows.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("evaluation_index", "candidate_id", "loss"))).alias("xs"))
    init = F.struct(F.lit(float(start_loss)).alias("loss"), F.lit(None).cast("string").alias("id"), F.lit(0).cast("long").alias("n"))
    fold = F.aggregate(
        "xs", init,
        lambda a, x: F.when(x["loss"] + min_delta < a["loss"], F.struct(x["loss"].alias("loss"), x["candidate_id"].cast("string").alias("id"), (a["n"] + 1).alias("n"))).otherwise(a),
    )
    return lists.select(*group, fold.alias("f")).select(*group, F.coalesce("f.id", F.lit("current")).alias("selected_candidate_id"), F.col("f.loss").alias("selected_loss"), F.col("f.n").alias("accepted_count"))


def best_result(results: DataFrame, group: list[str]) -> DataFrame:
    """Best round per group: target reached, then loss, then passes, then length; the earliest on full ties."""
    key = F.struct((~F.col("reached_target")).alias("a"), F.col("loss").alias("b"), (-F.col("pass_count")).alias("c"), F.col("description_length").alias("d"), F.col("round_index").alias("e"))
    rest = [c for c in results.columns if c not in group]
    return results.groupBy(*group).agg(F.min_by(F.struct(*rest), key).alias("r")).select(*group, *[F.col(f"r.{c}").alias(c) for c in rest])


def select_best_method(methods: DataFrame, method_order: list[str], group: list[str]) -> DataFrame:
    """The winning method per group: clean target first, then loss, prompt length, rounds, and the fixed order of methods."""
    place = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(m) for m in method_order]), F.col("method")), F.lit(0)), F.lit(99))
    good = F.col("reached_target") & F.coalesce("memorization_passed", F.lit(True))
    key = F.struct((~good).alias("a"), F.col("best_loss").alias("b"), F.col("description_length").alias("c"), F.col("round_count").alias("d"), place.alias("e"))
    rest = [c for c in methods.columns if c not in group]
    return methods.groupBy(*group).agg(F.min_by(F.struct(*rest), key).alias("r")).select(*group, *[F.col(f"r.{c}").alias(c) for c in rest])


def round_deltas(rounds: DataFrame, group: list[str]) -> DataFrame:
    """Loss change against the round before, whether it improved, and the version label (v0, v1, …) in force after the round."""
    w = W.partitionBy(*group).orderBy("round_index")
    best_before = F.min("loss").over(w.rowsBetween(W.unboundedPreceding, -1))
    rows = rounds.withColumns({"previous_loss": F.lag("loss").over(w), "best_before": best_before})
    rows = rows.withColumns({"loss_delta": half_even(F.col("previous_loss") - F.col("loss"), 4), "improved": F.coalesce(F.col("loss") < F.col("best_before"), F.lit(False))})
    version = F.sum(F.col("improved").cast("int")).over(w.rowsBetween(W.unboundedPreceding, W.currentRow))
    return rows.withColumn("version_label", F.concat(F.lit("v"), version.cast("string"))).drop("best_before")


def no_improvement(rounds: DataFrame, group: list[str], patience: int, max_rounds: int) -> DataFrame:
    """Streak of rounds without improvement after each round, and the reason to stop there (empty while running)."""
    rows = round_deltas(rounds, group)
    w = W.partitionBy(*group).orderBy("round_index")
    island = F.sum(F.col("improved").cast("int")).over(w.rowsBetween(W.unboundedPreceding, W.currentRow))
    rows = rows.withColumn("island_", island)
    inside = W.partitionBy(*group, "island_").orderBy("round_index")
    streak = F.row_number().over(inside) - F.when(F.col("island_") > 0, 1).otherwise(0)
    reason = F.when(F.coalesce("reached_target", F.lit(False)), "reached_target").when(F.col("no_improvement_streak") >= patience, "no_loss_improvement_patience").when(F.col("round_index") >= max_rounds, "max_rounds").otherwise("")
    return rows.withColumn("no_improvement_streak", streak).withColumn("stop_reason", reason).drop("island_")


def mask_ablation(masked: DataFrame, current: DataFrame, group: list[str], tie: str = "event_id") -> DataFrame:
    """Loss change when a segment is masked, its reading, and the rank of the segment in its group, largest change first.

    A group has a row per segment of one prompt, so its window stays small.
    """
    rows = masked.join(current.select(*group, F.col("loss").alias("current_loss")), group)
    delta = half_even(F.col("loss") - F.col("current_loss"), 4)
    rows = rows.withColumn("mask_loss_delta", delta)
    d = F.col("mask_loss_delta")
    reading = F.when(d > 0.5, "high_contribution_keep_or_refine").when(d < -0.5, "negative_contribution_rewrite_or_remove").otherwise("low_or_uncertain_contribution_small_step")
    rank = F.row_number().over(W.partitionBy(*group).orderBy(F.desc("mask_loss_delta"), tie))
    return rows.withColumns({"mask_interpretation": reading, "mask_rank": rank}).withColumnRenamed("loss", "masked_loss")


def segment_scores(segments: DataFrame, missing: Column, extra: Column, failed: Column, unstable: Column, loss: Column) -> DataFrame:
    """Weight and direction of every mutable segment from the failure counts; segments with no weight are left out."""
    kind = F.col("kind")
    base = failed + unstable * 0.5 + loss * 0.05
    score = (
        F.when(kind == "boundary_rules", base + missing * 1.2 + extra * 1.0).when(kind == "negative_rules", base * 0.7 + extra * 1.5)
        .when(kind == "task_definition", base * 0.8 + missing * 1.0).otherwise(base * 0.4)
    )
    direction = (
        F.when(kind == "negative_rules", F.when(extra >= missing, "tighten_exclusions").otherwise("keep_exclusions"))
        .when(kind == "boundary_rules", F.when(missing > extra, "expand_recall_boundary").when(extra > missing, "tighten_boundary").otherwise("stabilize_boundary"))
        .when(kind == "task_definition", "clarify_task_scope").otherwise("minimal_revision")
    )
    return segments.where("mutable").withColumns({"score": score, "direction": direction}).where(F.col("score") > 0)
