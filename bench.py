"""Times the headline queries: BENCH_SF_DIR (default sf0.1), BENCH_CPUS cores. Prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from spanloom import catalog
from spanloom.session import local_session

HEADLINE = [
    "tokenize", "tokenize_words", "split_sentences", "validate_spans", "consistency_scores", "consensus_scores", "route_tasks", "gold_compare", "concept_loss", "token_label_stats",
    "reflection_items", "dataset_stats", "leak_check", "chunk_documents", "memory_records", "vector_search", "exact_duplicates", "hash_embedding", "progress_eta", "running_best",
    "stream_progress", "stale_runs", "usage_summary", "human_review_queue", "apply_decisions",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = local_session(cpus, "bench", memory=os.environ.get("BENCH_MEMORY", "16g"))
    queries = catalog.queries()
    spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("sum(length(text))").collect()  # start the session before the clock
    times: dict[str, float] = {}
    for name in names:
        best = []
        for _ in range(runs):
            start = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            best.append(time.perf_counter() - start)
        times[name] = round(sorted(best)[len(best) // 2], 3)
        print(name, times[name], file=sys.stderr, flush=True)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
        "documents": docs, "cpus": cpus,
    }))
    spark.stop()


main()
