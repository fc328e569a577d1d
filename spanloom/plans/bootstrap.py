"""Bootstrap analysis: agreement, review queue, token statistics, reflection and contrastive examples of candidate runs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.agreement import consistency_scores
from ..operators.joins import candidates_with_samples, stats_samples
from ..operators.reflection import reflection_items
from ..operators.retrieval import contrastive_select, token_sets
from ..operators.review import human_review_queue
from ..operators.stats import run_manifest, token_label_stats, token_stats_report
from ..sources.writers import candidate_records, write_jsonl, write_table
from .reports import bootstrap_report, write_report


@dataclass
class BootstrapTables:
    scores: DataFrame
    review: DataFrame
    token_stats: DataFrame
    reflection: DataFrame
    contrastive: DataFrame
    manifest: DataFrame
    report: DataFrame


def analyze(samples: DataFrame, candidates: DataFrame, run_name: str) -> BootstrapTables:
    """All result tables, lazily. Candidates of unknown samples are left out of everything but the scores."""
    known = candidates_with_samples(candidates, samples)
    scores = consistency_scores(candidates)
    pool = stats_samples(samples, known, scores)
    stats = token_label_stats(pool)
    items = reflection_items(samples, known, stats)
    review = human_review_queue(candidates, scores)
    contrast = contrastive_select(token_sets(samples), token_sets(pool.where(F.size("spans") > 0)))
    manifest = run_manifest(run_name, sample=samples, candidate=candidates, review_task=review.select("sample_id").distinct(), reflection_plan=items.select("id", "candidate_id").distinct())
    return BootstrapTables(scores, review, token_stats_report(stats), items, contrast, manifest, bootstrap_report(scores, stats, items, manifest, run_name, review))


def run(samples: DataFrame, candidates: DataFrame, run_name: str, out: str, mode: str = "error") -> BootstrapTables:
    """Write every table. Scores and statistics are read back by later steps, so they are computed once."""
    spark = samples.sparkSession
    t = analyze(samples, candidates, run_name)
    for name in ("scores", "review", "token_stats", "reflection", "contrastive", "manifest"):
        write_table(getattr(t, name), f"{out}/{name}", mode=mode)
        setattr(t, name, spark.read.parquet(f"{out}/{name}"))
    write_jsonl(candidate_records(candidates_with_samples(candidates, samples)), f"{out}/candidates", mode)
    write_report(t.report, f"{out}/report", mode)
    return t
