import json
import os

from pyspark.sql import functions as F

from spanloom.plans import annotation, bootstrap, reports
from spanloom.schema import SPAN_DDL
from spanloom.sources import generations, readers, tables, writers
from spanloom.streaming import jobs


def put(folder, name, text):
    path = os.path.join(folder, name)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return path


SAMPLES = [
    {"id": "a", "text": "risk of heart failure rises", "gold_annotation": "[heart failure]{Specific_Term}", "metadata": {"source": "x"}},
    {"text": "common cold", "spans": [{"begin": 0, "end": 6, "text": "common", "label": "OOD_Term"}]},
]


def test_samples_and_candidates_round_trip(spark, folder):
    s = readers.read_samples(spark, put(folder, "s.jsonl", "\n".join(json.dumps(x) for x in SAMPLES)))
    rows = {r.id: r for r in s.collect()}
    assert [(x.start, x.end, x.label) for x in rows["a"].spans] == [(8, 21, "Specific_Term")]
    assert rows["sample-0002"].spans[0].start == 0 and rows["sample-0002"].error is None
    writers.write_jsonl(writers.sample_records(s), f"{folder}/out")
    again = {r.id: [tuple(x) for x in r.spans] for r in readers.read_samples(spark, f"{folder}/out").collect()}
    assert {k: [x[1:] for x in v] for k, v in again.items()} == {k: [tuple(x)[1:] for x in r.spans] for k, r in rows.items()}
    c = readers.read_candidates(spark, put(folder, "c.jsonl", "\n".join([
        json.dumps({"sample_id": "a", "text": "risk of heart failure rises", "runtime_annotation": {"annotation_markup": "[risk]{T}"}, "model_confidence": 0.91234}),
        json.dumps({"sample_id": "", "text": "x"}), "{broken",
    ])))
    got = sorted(c.collect(), key=lambda r: r.run)
    assert got[0].candidate_id == "candidate-001" and got[0].model_confidence == 0.9123 and got[0].spans[0].end == 4
    assert [r.error for r in got] == [None, "empty_sample_id", "invalid_json"]


def test_text_csv_and_dispatch(spark, folder):
    t = readers.read_tasks(spark, put(folder, "a.txt", "One. Two!\nThree")).orderBy("id").collect()
    assert [(r.id, r.text) for r in t] == [("txt-00001", "One."), ("txt-00002", "Two!"), ("txt-00003", "Three")]
    c = readers.read_tasks(spark, put(folder, "a.csv", 'text,who\n"hello, you",x\n" ",y\nbye,z\n')).orderBy("id").collect()
    assert [(r.id, r.text, r.meta["who"]) for r in c] == [("csv-00001", "hello, you", "x"), ("csv-00003", "bye", "z")]
    j = readers.read_tasks(spark, put(folder, "a.jsonl", '{"text": "x y"}\n\n{"id": "k"}\n')).orderBy("id").collect()
    assert [(r.id, r.error, len(r.tokens or [])) for r in j] == [("jsonl-00001", None, 2), ("k", "missing_text", 0)]


def test_upsert_and_merge(spark):
    a = spark.createDataFrame([("k1", 1, "old"), ("k2", 1, "kept")], "key string, version int, value string")
    b = spark.createDataFrame([("k1", 2, "new"), ("k3", 2, "added")], "key string, version int, value string")
    assert {r.key: r.value for r in tables.upsert(a, b, ["key"], "version").collect()} == {"k1": "new", "k2": "kept", "k3": "added"}
    names = lambda xs: spark.createDataFrame([(x,) for x in xs], "name string")
    assert sorted(r.name for r in tables.merge_catalogs(names(["a"]), names(["a", "b", "b"])).collect()) == ["a", "b", "b"]


def stream_folder(spark, folder):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    e.repartition(4).write.parquet(f"{folder}/events")
    return jobs.run_events(e), jobs.run_events(jobs.read_events(spark, f"{folder}/events"))


def test_streams_equal_batch(spark, folder):
    batch, stream = stream_folder(spark, folder)
    got = jobs.run_to_memory(jobs.live_progress(stream), "live", "complete", f"{folder}/ck1")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, jobs.live_progress(batch).collect()))
    wide = "40 days"
    got = jobs.run_to_memory(jobs.throughput(stream, slide=None, watermark=wide), "rate", "complete", f"{folder}/ck2")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, jobs.throughput(batch, slide=None).collect()))
    got = jobs.run_to_memory(jobs.active_sessions(stream, watermark=wide), "sess", "complete", f"{folder}/ck3")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, jobs.active_sessions(batch).collect()))


def test_stream_upsert_and_resume(spark, folder):
    batch, stream = stream_folder(spark, folder)
    jobs.upsert_stream(stream, f"{folder}/state", ["run_id"], ["event_id"], f"{folder}/ck").awaitTermination()
    got = generations.read_state(spark, f"{folder}/state", stream.schema).select("run_id", "event_id").collect()
    want = batch.groupBy("run_id").agg(F.max("event_id")).collect()
    assert generations.last_commit(spark, f"{folder}/state") == 3 and sorted(map(tuple, got)) == sorted(map(tuple, want))
    seen = []
    jobs.process_once(stream, lambda df, i: seen.append(df.count()), f"{folder}/ck4").awaitTermination()
    jobs.process_once(stream, lambda df, i: seen.append(df.count()), f"{folder}/ck4").awaitTermination()
    assert sum(seen) == batch.count()


def test_bootstrap_job(spark, folder):
    s = readers.read_samples(spark, put(folder, "s.jsonl", "\n".join(json.dumps(x) for x in SAMPLES)))
    lines = [json.dumps({"sample_id": i, "candidate_id": f"c{k}", "text": t, "annotation_markup": m, "model_confidence": 0.9}) for i, t, m in [("a", SAMPLES[0]["text"], "[heart failure]{T}"), ("sample-0002", "common cold", "[cold]{T}")] for k in (1, 2)]
    c = readers.read_candidates(spark, put(folder, "c.jsonl", "\n".join(lines)))
    t = bootstrap.run(s, c, "r1", f"{folder}/out")
    assert {r.metric: r.value for r in t.manifest.collect()} == {"sample_count": 2, "candidate_count": 4, "review_task_count": 0, "reflection_plan_count": 0}
    report = "\n".join(r.value for r in spark.read.text(f"{folder}/out/report").collect())
    assert "| high | 2 |" in report and report.startswith("# Concept Bootstrap Report")


def test_batch_annotation_job(spark):
    t = spark.createDataFrame([("t1", "the heart failure case"), ("t2", "nothing here")], "id string, text string")
    pool = spark.createDataFrame([("p1", "heart failure", [("T1", 0, 13, "heart failure", "Term", False)], "gold")], f"id string, text string, spans array<{SPAN_DDL}>, source_pool string")

    def predict(prompts):
        text = prompts.map(lambda p: p.rsplit("\n\n", 1)[-1])
        return text.map(lambda x: json.dumps({"text": x, "annotation": "[heart failure]{Term}" if "heart" in x else "", "explanation": "e", "confidence": 0.9}))

    out = annotation.run_batch(t, pool, predict, "job", "Mark terms.", "[span]{Term}", k=2, audit_rate=0.0)
    assert {r.task_id: (r.route, r.score) for r in out["routed"].collect()} == {"t1": ("auto_accept", 0.98), "t2": ("auto_accept", 0.98)}
    assert out["predictions"].where("size(spans) = 1").count() == 2 and out["reviews"].count() == 0


def test_history_export(spark):
    h = spark.createDataFrame([(1, 2, "b", "y"), (1, 1, "a", "x")], "conv int, turn int, role string, text string")
    j = json.loads(reports.history_export(h, "2024-01-01", "conv", "turn").first().value)
    assert j["history_count"] == 2 and [e["text"] for e in j["history"]] == ["x", "y"]


def test_text_folder_keeps_ids_apart(spark, folder):
    for name in ("a.txt", "b.txt"):
        with open(f"{folder}/{name}", "w") as f:
            f.write("One here. Two there.")
    assert sorted(r.id for r in readers.read_text_tasks(spark, folder).collect()) == ["txt-a-00001", "txt-a-00002", "txt-b-00001", "txt-b-00002"]
    assert sorted(r.id for r in readers.read_text_tasks(spark, f"{folder}/a.txt").collect()) == ["txt-00001", "txt-00002"]
