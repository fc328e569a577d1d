"""Agreement between repeated candidates: pairwise consistency and consensus scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import half_even
from ..functions.spans import key_f1, signature, signature_keys, span_key


PARTS = 16


def _units(col: Column) -> Column:
    """Four-place decimals as whole units, so that sums do not depend on their order."""
    return F.round(col * 10000).cast("long")


def signature_groups(candidates: DataFrame, key: str = "sample_id", order: str = "run", confidence: str = "model_confidence") -> DataFrame:
    """Candidates of one key with the same span set become one row with a count.

    Copies collapse before the shuffle, so a key that holds a large share of all rows costs as much as its
    distinct answers, not as its rows.
    """
    rows = candidates.select(
        key, F.col(order).alias("order_"), F.col(confidence).alias("conf_"), F.coalesce(signature(F.col("spans"), "consistency"), F.lit("")).alias("sig"),  # never NULL: no filter that would compute it twice
    )
    return rows.groupBy(key, "sig").agg(
        F.count(F.lit(1)).alias("n"), F.min("order_").alias("first_at"),
        F.sum(_units(F.col("conf_"))).alias("conf_units"), F.count("conf_").alias("conf_n"),
    )


def answer_pairs(groups: DataFrame, key: str = "sample_id") -> DataFrame:
    """All pairs of distinct answers of a key, each answer also with itself; columns ``l_*`` and ``r_*``.

    An equi-join on the key, nothing is collected. Adaptive execution splits a hot key over tasks as long as nothing above asks for the
    rows of a key together; see ``_parts``. Both sides must keep the same columns: then they are one exchange, and the candidates
    are read and grouped once.
    """
    side = lambda p: groups.select(F.col(key).alias(f"{p}_key"), *[F.col(c).alias(f"{p}_{c}") for c in ("sig", "n", "first_at", "conf_units", "conf_n")])
    return side("l").join(side("r"), (F.col("l_key") == F.col("r_key")) & (F.col("l_sig") <= F.col("r_sig"))).withColumnRenamed("l_key", key)


def _parts(rows: DataFrame, key: str, by: str) -> DataFrame:
    """Rows dealt anew by key and a part of it.

    With this exchange above a join on the key, the join may be split where a key is hot, and a hot key is then summed up in ``PARTS``
    tasks before its parts meet.
    """
    return rows.withColumn("part_", F.pmod(F.xxhash64(by), F.lit(PARTS))).drop(by).repartition(key, "part_")


def pairwise_f1(groups: DataFrame, key: str = "sample_id") -> DataFrame:
    """(key, f1, weight): F1 of the candidates of each key, weighted by how many pairs of candidates have it."""
    own = F.col("l_sig") == F.col("r_sig")
    f1 = F.when(own, 1.0).otherwise(key_f1(signature_keys(F.col("l_sig")), signature_keys(F.col("r_sig")), "consistency"))
    n = F.greatest("l_n", "r_n")
    weight = F.when(own, F.shiftright(n * (n - 1), 1)).otherwise(F.col("l_n") * F.col("r_n"))
    return answer_pairs(groups, key).select(key, f1.alias("f1"), weight.alias("weight")).where("weight > 0")


def consistency_scores(
    candidates: DataFrame, key: str = "sample_id", order: str = "run", confidence: str = "model_confidence",
    high: float = 0.95, medium: float = 0.6,
) -> DataFrame:
    """Mean pairwise F1, exact rate against the first candidate, mean confidence, uncertainty and route per sample."""
    pairs = answer_pairs(signature_groups(candidates, key, order, confidence), key)
    own = F.col("l_sig") == F.col("r_sig")
    n = F.greatest("l_n", "r_n")
    f1 = key_f1(signature_keys(F.col("l_sig")), signature_keys(F.col("r_sig")), "consistency")
    units = F.when(own, n * (n - 1) * F.lit(5000)).otherwise(_units(f1) * F.col("l_n") * F.col("r_n"))
    # Figures of one answer are taken from its pair with itself, using both sides so that neither loses a column.
    mine = lambda col: F.when(own, col)
    figures = pairs.select(
        key, "l_sig", mine(n).alias("n"), units.alias("f1_units"), mine(F.struct(F.least("l_first_at", "r_first_at").alias("at"), n.alias("n"))).alias("lead"),
        mine(F.greatest("l_conf_units", "r_conf_units")).alias("conf_units"), mine(F.greatest("l_conf_n", "r_conf_n")).alias("conf_n"),
    )
    added = [F.sum("n").alias("n"), F.sum("f1_units").alias("f1_units"), F.min("lead").alias("lead"), F.sum("conf_units").alias("conf_units"), F.sum("conf_n").alias("conf_n")]
    per_key = _parts(figures, key, "l_sig").groupBy(key, "part_").agg(*added).groupBy(key).agg(*added)
    n = F.col("n")
    pairs = n * (n - 1) / 2
    f1 = F.when(n == 1, 1.0).otherwise(half_even(F.col("f1_units") / (pairs * 10000), 4))
    conf = F.when(F.col("conf_n") > 0, half_even(F.col("conf_units") / (F.col("conf_n") * F.lit(10000.0)), 4))
    scored = per_key.select(
        key, n.alias("candidate_count"), f1.alias("pairwise_span_f1"), half_even(F.col("lead.n") / n, 4).alias("exact_match_rate"),
        conf.alias("average_model_confidence"),
    )
    f1, conf = F.col("pairwise_span_f1"), F.col("average_model_confidence")
    uncertainty = F.when(conf.isNull(), half_even(1 - f1, 4)).otherwise(half_even((1 - f1) * 0.7 + (1 - conf) * 0.3, 4))
    sure = conf.isNull() | (conf >= 0.7)
    route = F.when((f1 >= high) & (F.col("exact_match_rate") >= 0.8) & sure, "high").when(f1 >= medium, "medium").otherwise("low")
    return scored.withColumns({"uncertainty_score": uncertainty, "route": route})


def batch_signature(spans: Column) -> Column:
    """The ordered answer of a prediction: array of (start, end, text, label), comparable as a whole."""
    return F.transform(
        spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"), s["label"].alias("label"))
    )


def signature_group_id(sig: Column) -> Column:
    """Short digest that names an answer."""
    return F.substring(F.sha1(F.to_json(sig)), 1, 12)


def _sig_f1(left: Column, right: Column) -> Column:
    """F1 of two answers; most are the common answer itself, and that one needs no keys."""
    keys = lambda sig: F.array_distinct(F.transform(sig, lambda s: span_key(s, "batch")))
    return F.when(left == right, 1.0).otherwise(key_f1(keys(left), keys(right), "batch"))


def _answers(predictions: DataFrame, key: str, best: bool = False) -> DataFrame:
    """Distinct answers per task with counts and sums; with ``best``, also the best-scored prediction (the first on ties)."""
    extra = []
    if best:
        rank = F.struct(F.coalesce("score", F.lit(0.0)).alias("s"), (-F.col("run")).alias("o"), F.col("prediction_id").alias("id"))
        extra = [F.max(rank).alias("best")]
    return predictions.withColumn("sig", batch_signature(F.col("spans"))).groupBy(key, "sig").agg(
        F.count(F.lit(1)).alias("n"), F.sum(_units(F.col("score"))).alias("conf_units"), F.count("score").alias("conf_n"), F.sum("rule_risk").alias("risk"), *extra,
    )


def _consensus(answers: DataFrame, key: str) -> DataFrame:
    best = [F.max("best").alias("best")] if "best" in answers.columns else []
    return answers.groupBy(key).agg(
        F.min(F.struct((-F.col("n")).alias("neg"), F.col("sig"))).alias("top"), F.sum("n").alias("total"),
        F.sum("conf_units").alias("conf_units"), F.sum("conf_n").alias("conf_n"), F.sum("risk").alias("risk"), *best,
    ).select(key, F.col("top.sig").alias("consensus"), (-F.col("top.neg")).alias("best_count"), "total", "conf_units", "conf_n", "risk", *(["best"] if best else []))


def consensus_scores(predictions: DataFrame, key: str = "task_id", with_best: bool = False) -> DataFrame:
    """Score of each task from its most common answer (ties: the smallest answer); ``with_best`` adds ``best_prediction_id``."""
    answers = _answers(predictions, key, with_best)
    top = _consensus(answers, key)
    own = answers.select(F.col(key).alias("a_key"), F.col("sig").alias("a_sig"), *[F.col(c).alias(f"a_{c}") for c in answers.columns if c not in (key, "sig")])
    rows = own.join(top, F.col("a_key") == F.col(key))
    # The task's sums arrive with the consensus and once more from the answers: both sides then read the same columns and share one exchange.
    both = {"total": "a_n", "conf_units": "a_conf_units", "conf_n": "a_conf_n", "risk": "a_risk"}
    once = ["best_count", *both, *(["best", "a_best"] if with_best else [])]
    rows = rows.select(key, "a_sig", (_sig_f1(F.col("a_sig"), F.col("consensus")) * F.col("a_n")).alias("f1_sum"), *once, *both.values())
    added = [F.sum("f1_sum").alias("f1_sum"), *[F.max(c).alias(c) for c in once], *[F.sum(c).alias(c) for c in both.values()]]
    sums = _parts(rows, key, "a_sig").groupBy(key, "part_").agg(*added).groupBy(key).agg(*added)
    best = [F.greatest("best", "a_best").alias("best")] if with_best else []
    sums = sums.select(key, "f1_sum", "best_count", *[F.greatest(a, b).alias(a) for a, b in both.items()], *best)
    total = F.col("total")
    agreement, exact = F.col("f1_sum") / total, F.col("best_count") / total
    conf = F.when(F.col("conf_n") > 0, F.col("conf_units") / (F.col("conf_n") * F.lit(10000.0))).otherwise(0.5)
    risk = F.col("risk") / total
    return sums.select(
        key, total.alias("candidate_count"),
        half_even(agreement * 0.5 + exact * 0.2 + conf * 0.2 + (1 - risk) * 0.1, 4).alias("score"),
        half_even(agreement, 4).alias("agreement"), half_even(exact, 4).alias("exact_match_rate"),
        half_even(conf, 4).alias("avg_confidence"), half_even(risk, 4).alias("avg_rule_risk"), *([F.col("best.id").alias("best_prediction_id")] if with_best else []),
    )


def consensus_candidates(predictions: DataFrame, key: str = "task_id") -> DataFrame:
    """Each prediction with its F1 to the consensus and the digests of its own and the common answer."""
    top = _consensus(_answers(predictions, key), key).select(key, "consensus")
    own = predictions.select(key, "prediction_id", batch_signature(F.col("spans")).alias("sig"), "score", "rule_risk")
    return own.join(top, key).select(
        key, "prediction_id", half_even(_sig_f1(F.col("sig"), F.col("consensus")), 4).alias("span_f1_to_consensus"),
        F.col("score").alias("model_confidence"), "rule_risk",
        signature_group_id(F.col("sig")).alias("agreement_group"), signature_group_id(F.col("consensus")).alias("consensus_group"),
    )
