"""Keyed state batch by batch, alerts of silent runs while the stream runs, and a corpus run that goes on after a stop."""

import os
import random

import pytest
from pyspark.sql import functions as F

from spanloom.plans import corpus
from spanloom.sources import generations as gn
from spanloom.streaming import alerts, jobs

ROW = "kind string, item_id long, status string, updated_at long, event_id long, tags array<string>"


def rows(spark, data):
    return spark.createDataFrame(data, ROW)


def state(spark, target):
    return {(r.kind, r.item_id): (r.status, r.updated_at, r.event_id) for r in gn.read_state(spark, target, rows(spark, []).schema).collect()}


def written(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet"))


def test_state_after_batches(spark, folder):
    """Older versions that come later change nothing; equal versions are decided by the event; one batch may hold a key twice."""
    target, keys, order = f"{folder}/state", ["kind", "item_id"], ["updated_at", "event_id"]
    assert state(spark, target) == {} and gn.last_commit(spark, target) == -1
    gn.upsert_generation(rows(spark, [("task", 1, "new", 10, 1, ["a"]), ("task", 1, "done", 20, 2, []), ("review", 1, "open", 5, 3, None)]), target, 0, keys, order)
    gn.upsert_generation(rows(spark, [("task", 1, "old", 15, 4, []), ("review", 1, "left", 5, 2, []), ("task", 2, "new", 1, 5, [])]), target, 1, keys, order)
    want = {("task", 1): ("done", 20, 2), ("review", 1): ("open", 5, 3), ("task", 2): ("new", 1, 5)}
    assert state(spark, target) == want
    assert gn.upsert_generation(rows(spark, []), target, 2, keys, order) == 0 and state(spark, target) == want
    # Full ties are decided by the other columns, whatever the order of the rows.
    for k, pair in enumerate([("a", "b"), ("b", "a")]):
        gn.upsert_generation(rows(spark, [("task", 9, s, 1, 1, []) for s in pair]), f"{folder}/tie{k}", 0, keys, order)
        assert state(spark, f"{folder}/tie{k}") == {("task", 9): ("b", 1, 1)}


def test_repeated_and_broken_batches(spark, folder):
    target, keys, order = f"{folder}/state", ["kind", "item_id"], ["updated_at", "event_id"]
    first, second = [("task", k, "new", 1, k, []) for k in range(50)], [("task", k, "done", 2, 100 + k, []) for k in range(0, 50, 7)]
    gn.upsert_generation(rows(spark, first), target, 0, keys, order, 8)
    gn.upsert_generation(rows(spark, second), target, 1, keys, order, 8)
    want = state(spark, target)
    gn.upsert_generation(rows(spark, second), target, 1, keys, order, 8)
    assert state(spark, target) == want and sum(v[0] == "done" for v in want.values()) == 8
    # A batch that wrote its files but did not commit is not seen, and runs again as if nothing had happened.
    rows(spark, [("task", 1, "lost", 9, 999, [])]).withColumn("bucket", F.lit(0)).write.partitionBy("bucket").parquet(f"{target}/gen=2")
    assert state(spark, target) == want
    gn.upsert_generation(rows(spark, [("task", 1, "kept", 9, 999, [])]), target, 2, keys, order, 8)
    assert state(spark, target) == want | {("task", 1): ("kept", 9, 999)}


def test_bytes_follow_the_batch(spark, folder):
    """A batch of one key rewrites its bucket, not the table."""
    target, keys, order = f"{folder}/state", ["kind", "item_id"], ["updated_at", "event_id"]
    everything = [("task", k, f"status {random.Random(k).random()}", 1, k, []) for k in range(4000)]
    assert gn.upsert_generation(rows(spark, everything), target, 0, keys, order, 32) == 32
    assert gn.upsert_generation(rows(spark, [("task", 77, "changed", 2, 9000, [])]), target, 1, keys, order, 32) == 1
    assert written(f"{target}/gen=1") < 0.15 * written(f"{target}/gen=0")
    got = state(spark, target)
    assert len(got) == 4000 and got["task", 77] == ("changed", 2, 9000)


def test_upsert_partitions_and_replace(spark):
    from spanloom.sources import tables

    t = spark.createDataFrame([("a", 1, "x"), ("b", 1, "x"), ("c", 1, "y")], "key string, version int, part string")
    got = tables.upsert_partitions(t, spark.createDataFrame([("b", 2, "x"), ("d", 1, "x")], t.schema), ["key"], "version", "part")
    assert {tuple(r) for r in got.collect()} == {("a", 1, "x"), ("b", 2, "x"), ("d", 1, "x")}  # part y is not touched
    assert tables.replace_catalog(t, t.select("part", "key", "version").where("key = 'a'")).collect() == [("a", 1, "x")]


def feed(spark, folder, files):
    """Files of (run_id, second), written one after the other."""
    for pairs in files:
        spark.createDataFrame([(r, int(s * 1_000_000) + 1_700_000_000_000_000) for r, s in pairs], "run_id long, us long").select("run_id", F.timestamp_micros("us").alias("ts")).coalesce(1).write.mode("append").parquet(f"{folder}/feed")
    return spark.readStream.schema("run_id long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{folder}/feed")


def drained(spark, stream, folder):
    out = alerts.silence_alerts(stream, delay_seconds=300)
    out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/ck").trigger(availableNow=True).start().awaitTermination()
    return sorted((r.run_id, r.started_at, r.last_ts, r.alert_at, r.event_count) for r in spark.read.schema(out.schema).parquet(f"{folder}/out").collect())


def test_alerts_equal_the_batch_form(spark, folder):
    """Late events that close a gap, runs that resume after an alert, a pause of exactly the limit, and the last stretch still open."""
    files = [
        [(1, 0), (1, 60), (2, 0), (3, 0), (4, 10)],
        [(1, 400), (2, 119), (2, 239), (4, 130.001), (1, 200)],  # 2 pauses 120 s, 4 a little more; 1 comes late at 200
        [(1, 290), (3, 500), (2, 380)],  # 290 joins 200 and 400
        [(9, 1500)],
        [(3, 1400), (3, 1450), (2, 1550), (9, 1600)],
        [(9, 3000)],
        [(1, 3100), (9, 3060)],
    ]
    got = drained(spark, feed(spark, folder, files), folder)
    table = spark.read.parquet(f"{folder}/feed")
    want = sorted((r.run_id, r.started_at, r.last_ts, r.alert_at, r.event_count) for r in alerts.silence_alerts(table, delay_seconds=300).collect())
    assert got == want and len(got) > 8
    spans = {(r, int((a.timestamp() - 1_700_000_000)), int(b.timestamp() - 1_700_000_000), n) for r, a, b, _, n in got}
    assert (4, 10, 10, 1) in spans and (4, 130, 130, 1) in spans and (3, 0, 0, 1) in spans and (3, 1400, 1450, 2) in spans and (2, 0, 239, 3) in spans
    assert (1, 200, 400, 3) in spans and not any(r == 1 and b >= 3100 for r, _, b, _ in spans)


def test_alerts_go_on_after_a_restart(spark, folder):
    files = [[(1, 0), (2, 30)], [(2, 100), (3, 700)]]
    drained(spark, feed(spark, folder, files), folder)
    got = drained(spark, feed(spark, folder, [[(1, 1000), (3, 760)], [(5, 4000)]]), folder)
    table = spark.read.parquet(f"{folder}/feed")
    assert got == sorted((r.run_id, r.started_at, r.last_ts, r.alert_at, r.event_count) for r in alerts.silence_alerts(table, delay_seconds=300).collect())


def test_stretches_are_joined():
    assert alerts.joined([(5, 5, 1), (0, 0, 1), (11, 11, 1), (30, 30, 2)], 5) == [(0, 5, 2), (11, 11, 1), (30, 30, 2)]


def test_sliding_throughput_stream(spark, folder):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    e.repartition(3).write.parquet(f"{folder}/events")
    stream = jobs.run_events(jobs.read_events(spark, f"{folder}/events"))
    got = jobs.run_to_memory(jobs.throughput(stream, watermark="40 days"), "slide", "complete", f"{folder}/ck")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, jobs.throughput(jobs.run_events(e)).collect()))


def plan(spark, n=10):
    return spark.createDataFrame([(f"t{k}", k) for k in range(n)], "task_id string, task_index long")


def test_run_goes_on_from_the_last_commit(spark, folder):
    seen = []

    def work(todo, so_far):
        seen.append((sorted(r.task_id for r in todo.collect()), so_far.count()))
        return todo.where("task_index <> 3").select("task_id", F.explode(F.array(F.lit("x"), F.lit("y"))).alias("text"), F.lit("accepted").alias("status"))

    half = corpus.generate(plan(spark), work, f"{folder}/run", parts=4, stop_after=2)
    assert half.count() == 6
    seen.clear()
    whole = corpus.generate(plan(spark), work, f"{folder}/run", parts=4)
    assert [s for s in seen if s[0]] == [(["t2", "t6"], 12), (["t3", "t7"], 16)]  # t3 has no items and is finished all the same
    assert {r.task_id: len(r["items"]) for r in whole.collect()} == {f"t{k}": 0 if k == 3 else 2 for k in range(10)}
    seen.clear()
    assert corpus.generate(plan(spark), work, f"{folder}/run", parts=4).count() == 10 and not any(s[0] for s in seen)


def test_run_that_breaks_inside_a_part(spark, folder):
    def broken(todo, so_far):
        text = F.when(F.col("task_index") == 5, F.raise_error(F.lit("model gone"))).otherwise(F.lit("x"))
        return todo.select("task_id", text.alias("text"))

    with pytest.raises(Exception, match="model gone"):
        corpus.generate(plan(spark), broken, f"{folder}/run", parts=4).count()
    fine = lambda todo, so_far: todo.select("task_id", F.lit("y").alias("text"))
    got = {r.task_id: r["items"][0].text for r in corpus.generate(plan(spark), fine, f"{folder}/run", parts=4).collect()}
    assert got == {f"t{k}": "x" if k % 4 == 0 else "y" for k in range(10)}


def test_corpus_plan_end_to_end(spark):
    """Seeds to chunks, records, index, plan, recall and judgement."""
    text = "Linguistics studies language. Morphology studies words and their parts. " * 12
    seeds = spark.createDataFrame([(f"d{k}", f"Title {k}", text + f"Part {k}.", "reference", "en", "general", ["morphology", "syntax"], {}, None) for k in range(3)],
                                  "doc_id string, title string, text string, source_type string, language string, domain string, tags array<string>, metadata map<string,string>, error string")
    records = corpus.prepare(seeds, 200, 20).cache()
    assert records.count() > 6
    index = corpus.index_texts(records).cache()
    genres = spark.createDataFrame([("qa", 0.7, 0), ("term", 0.3, 1)], "name string, weight double, position int")
    tasks = corpus.plan(records, genres, "p", 8, 2, "linguistics", "en").cache()
    assert tasks.count() == 4 and {r.focus for r in tasks.collect()} == {"morphology", "syntax"}
    hits = corpus.recall(tasks, index, 3)
    assert hits.count() == 12 and {r["rank"] for r in hits.collect()} == {1, 2, 3}
    items = tasks.select(F.col("task_id").alias("id"), "task_id", F.col("task_index").alias("at"), F.lit("How are words formed here?").alias("prompt"), F.lit("Words are formed from parts; morphology describes how. " * 3).alias("response"),
                         F.lit("en").alias("language"), F.lit("linguistics").alias("domain"), F.array(F.lit("c")).alias("source_chunk_ids"), F.array(F.lit("c")).alias("allowed_ids"), F.array(F.lit("Words")).alias("term_pack"))
    judged = {r.at: (r.status, r.issues) for r in corpus.judge(items, "en", "linguistics", []).collect()}
    assert judged[1] == ("accepted", []) and all(judged[k] == ("review", ["duplicate"]) for k in (2, 3, 4))
