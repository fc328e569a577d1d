"""Hot keys and single tasks: what would grow with the data is spread, with the same results."""

import random
import re

from pyspark.sql import functions as F

from spanloom.operators import corpus, leakage, runs
from spanloom.sources.positions import with_running_sum


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_running_sum(spark):
    df = spark.range(0, 500, 1, 6).select(F.col("id"), (F.col("id") % 7).alias("v"))
    got = {r.id: r.before for r in with_running_sum(df, [F.desc("id")], F.col("v"), "before").collect()}
    total = 0
    for i in reversed(range(500)):
        assert got[i] == total
        total += i % 7
    assert with_running_sum(df.where("false"), ["id"], F.col("v"), "before").count() == 0


def test_one_run_and_hour_is_many_tasks(spark):
    """A hot run and hour is cut into blocks; values are those of one window."""
    e = spark.sql("SELECT id AS event_id, IF(id % 10 = 0, id % 3, 9) AS run_id, timestamp_seconds(id) AS ts, double((id * 37) % 101) AS loss, id % 5 AS pass_count, id AS tokens, IF(id % 2 = 0, 'call_retried', 'call_succeeded') AS event_type FROM range(3000)")
    names = ["event_id", "best_loss", "best_pass_count", "total_tokens", "retry_count"]
    whole = runs.running_best(e, bucket="year").select(names)
    cut = runs.running_best(e, bucket="year", block_rows=100)
    assert sorted(map(tuple, cut.select(names).collect())) == sorted(map(tuple, whole.collect()))
    rows = e.withColumn("b_", F.date_trunc("year", "ts"))
    full = rows.groupBy("run_id", "b_").count().where("count > 100").select(F.col("run_id").alias("k_"), F.col("b_").alias("t_"))
    blocks = runs._blocks(rows, full, "run_id", "ts", "event_id", 100).groupBy("run_id", "b_", "block_").count().collect()
    assert max(r["count"] for r in blocks) <= 100 and sum(r.run_id == 9 for r in blocks) >= 27
    spread = {r[0] for r in runs._blocks(rows, full, "run_id", "ts", "event_id", 100).where("run_id = 9").repartition(8, "run_id", "b_", "block_").select(F.spark_partition_id()).collect()}
    assert len(spread) > 1 and re.search(r"hashpartitioning\(run_id#\d+L, b_#\d+, block_#\d+L", plan_of(cut))  # the windows are dealt by block, too
    t = spark.createDataFrame([(0, 900), (1, 900), (2, 900), (9, 2700)], "run_id long, total long")
    names = ["event_id", "completed", "progress", "eta_seconds", "elapsed_seconds"]
    assert sorted(map(str, runs.progress_eta(e, t, block_rows=50).select(names).collect())) == sorted(map(str, runs.progress_eta(e, t, bucket="year").select(names).collect()))


def test_plans_and_packs_without_a_single_task(spark):
    """What is brought into one task is a row per task or per category, never the rows themselves."""
    foci = spark.range(0, 300, 1, 5).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("focus"), F.col("id").alias("first_at"), F.lit(0).alias("first_pos"))
    genres = spark.createDataFrame([("a", 0.5, 0), ("b", 0.5, 1)], "name string, weight double, position int")
    tasks = corpus.plan_tasks(genres, foci, "p", 20, 2, "d", "en")
    assert [r.focus for r in tasks.orderBy("task_index").collect()] == [f"f{k}" for k in range(10)]
    rnd = random.Random(3)
    chunks = [(k, "x" * rnd.randint(0, 9), rnd.choice([None, 0.5, 1.0])) for k in range(400)]
    df = spark.createDataFrame(chunks, "position long, text string, score double").repartition(6)
    packed = corpus.budget_pack(df, 250, summary="abc")
    left, want = 247, {}
    for k, t, _ in sorted(chunks, key=lambda c: (-(c[2] or 0.0), c[0])):
        if t and left > 0:
            want[k] = t[:left]
            left -= len(want[k])
    assert {r.position: r.text for r in packed.collect()} == want
    for df in (packed, tasks):
        plan = plan_of(df)
        assert "CartesianProduct" not in plan
        for part in plan.split("SinglePartition")[1:]:  # only sums per task, block or category come together
            assert "Sort" not in part.split("\n")[1] or "part_" in part or "position" in part


def test_units_are_held_back_before_the_join(spark):
    """Of many units only those of blocked hashes (and few others) go on."""
    rnd = random.Random(1)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(8))
    secret = "hidden passage number"
    texts = [(f"t{k}", " ".join(word() for _ in range(60)) + (f" {secret}" if k % 10 == 0 else "")) for k in range(100)]
    df = spark.createDataFrame(texts, "id string, text string")
    fp = leakage.fingerprint(spark.createDataFrame([("1", secret, "gold_span")], "source_id string, text string, source_type string"))
    units = df.select(F.explode(leakage.leak_units(F.col("text")))).count()
    rows = leakage.possible_units(df, fp.where("blocked")).count()
    assert units > 15_000 and rows <= 10 * 6 + 0.01 * units
    got = {r.id: (r.match_count, r.severity, len(r.matched_hashes)) for r in leakage.leak_check(df, fp, shown=2).collect()}
    assert all(got[f"t{k}"] == ((6, "critical_leak", 2) if k % 10 == 0 else (0, "clean", 0)) for k in range(100))
