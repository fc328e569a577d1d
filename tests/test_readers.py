"""Places of rows in files: the same whatever the packing, without a sort or a copy of the input."""

import json
import os

import pytest
from pyspark.sql import functions as F

from spanloom.sources import readers
from spanloom.sources.positions import with_file_position


def files(folder, parts):
    os.makedirs(folder, exist_ok=True)
    for name, lines in parts.items():
        with open(f"{folder}/{name}", "w", encoding="utf-8", newline="") as f:
            f.write("".join(x + "\n" for x in lines))
    return folder


@pytest.fixture()
def small_splits(spark):
    keys = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum"]
    old = {k: spark.conf.get(k, None) for k in keys}

    def pack(size, least=None):
        spark.conf.set(keys[0], size)
        spark.conf.set(keys[1], "1")
        spark.conf.set(keys[2], str(least or 1))

    yield pack
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_positions_do_not_depend_on_packing(spark, folder, small_splits):
    parts = {"b.txt": [f"b{k} " + "x" * (k % 50) for k in range(400)], "a b.txt": [f"a{k}" for k in range(30)], "c.txt": [], "d.txt": ["", "last"]}
    path = files(f"{folder}/in", parts)
    want = {line: k + 1 for k, line in enumerate(x for name in sorted(parts) for x in parts[name])}
    for size, least in (("128m", 1), ("200", 1), ("1000", 64), ("64k", 3)):
        small_splits(size, least)
        rows = with_file_position(spark.read.text(path))
        assert {r.value: r.position for r in rows.collect()} == want, size
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "rangepartitioning" not in plan and "Checkpoint" not in plan and "Scan ExistingRDD" not in plan
    assert with_file_position(spark.read.text(files(f"{folder}/none", {"e.txt": []}))).count() == 0


def test_rows_are_not_moved(spark, folder):
    """Only the counts of the splits are exchanged."""
    rows = readers._lines(spark, files(f"{folder}/in", {"a.jsonl": ['{"text": "x"}'] * 50}))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "Sort" not in plan.replace("sum(n_", "").split("Window")[0] and "Repartition" not in plan


def test_jsonl_of_several_files(spark, folder, small_splits):
    path = files(f"{folder}/in", {"b.jsonl": [json.dumps({"text": f"b {k}"}) for k in range(5)], "a.jsonl": [json.dumps({"text": "a 0"}), "", "{broken", json.dumps({"id": "own", "text": "a 3"})]})
    for size in ("128m", "40"):
        small_splits(size)
        got = {r.text or r.error: (r.id, r.meta["source"]) for r in readers.read_jsonl_tasks(spark, path).collect()}
        assert got["a 0"] == ("jsonl-00001", "a.jsonl") and got["invalid_json"] == ("jsonl-00003", "a.jsonl") and got["a 3"] == ("own", "a.jsonl")
        assert [got[f"b {k}"] for k in range(5)] == [(f"jsonl-{k + 5:05d}", "b.jsonl") for k in range(5)]
    with pytest.raises(ValueError, match="bad input row"):
        readers.read_jsonl_tasks(spark, path, strict=True)


def test_csv_of_several_files(spark, folder, small_splits):
    path = files(f"{folder}/in", {"b.csv": ["text,who", '"two\nlines, here",x', '" ",y', "bye,z"], "a.csv": ["text,who", "first,w"]})
    for size in ("128m", "20"):
        small_splits(size)
        got = {r.text: (r.id, r.meta["who"], r.meta["source"], r.meta["row_index"]) for r in readers.read_csv_tasks(spark, path).collect()}
        assert got == {"first": ("csv-00001", "w", "a.csv", "1"), "two\nlines, here": ("csv-00002", "x", "b.csv", "2"), "bye": ("csv-00004", "z", "b.csv", "4")}


def test_seed_documents(spark, folder):
    path = files(f"{folder}/in", {
        "a.jsonl": [json.dumps({"id": " s1 ", "title": " T ", "text": " body ", "tags": [" x "], "language": ""}), "", json.dumps({"text": "no id", "domain": "law"})],
        "b.jsonl": [json.dumps({"text": " "}), json.dumps({"text": "t", "tags": ["", "y"]}), json.dumps({"text": "u", "metadata": {"k": "v"}})]})
    got = {r.doc_id: r for r in readers.read_seed_documents(spark, path).collect()}
    assert set(got) == {"s1", "seed-0003", "seed-0004", "seed-0005", "seed-0006"}
    assert (got["s1"].title, got["s1"].text, got["s1"].tags, got["s1"].language, got["s1"].error) == ("T", "body", ["x"], "unknown", None)
    assert (got["seed-0003"].title, got["seed-0003"].domain, got["seed-0003"].source_type) == ("seed-0003", "law", "reference")
    assert (got["seed-0004"].error, got["seed-0005"].error, got["seed-0006"].metadata) == ("empty_text", "bad_tags", {"k": "v"})


def test_samples_and_candidates_of_several_files(spark, folder, small_splits):
    s = files(f"{folder}/s", {"2.jsonl": [json.dumps({"text": "c"})], "1.jsonl": [json.dumps({"text": "a"}), json.dumps({"id": "k", "text": "b"})]})
    c = files(f"{folder}/c", {"2.jsonl": [json.dumps({"sample_id": "k", "text": "b"})], "1.jsonl": [json.dumps({"sample_id": "k", "text": "b"})] * 3})
    for size in ("128m", "25"):
        small_splits(size)
        assert {r.text: r.id for r in readers.read_samples(spark, s).collect()} == {"a": "sample-0001", "b": "k", "c": "sample-0003"}
        assert sorted((r.run, r.candidate_id) for r in readers.read_candidates(spark, c).collect()) == [(k, f"candidate-{k:03d}") for k in range(1, 5)]
        assert readers.read_samples(spark, s).where(F.col("text") == "c").count() == 1
