"""The pipeline against plain restatements of its stages."""

import math

import duckdb
import numpy as np
import zlib

import corpus_pipeline
from spanloom.llm import quality, secrets
from spanloom.llm.shared import stored

from .data import documents, frame, hits, links

SF = "/root/testdata/sf0.001"


def test_stages_agree_with_brute_force(spark):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    rows = {r[0]: r for r in con.sql("select * from documents").fetchall()}
    kept = {r[0] for r in con.sql(f"select doc_id from ({quality.judged_sql()}) where kept").fetchall()}
    _, top = links([(i, rows[i][1]) for i in sorted(kept)])
    kept = {i for i in kept if top[i] == i}
    items = duckdb.sql(f"select item_id, text from '{SF}/benchmark.parquet'").fetchall()
    kept = {i for i in kept if not hits(rows[i][1], items)[1]}

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = stored(stage(spark, docs, SF))
        assert docs.columns == columns, name
    assert {r["doc_id"] for r in docs.select("doc_id").collect()} == kept
    model = secrets.trained(docs, secrets.findings(docs))
    masked = {i: secrets.redact(rows[i][1], model) for i in kept}
    out = corpus_pipeline.STAGES[3][1](spark, docs, SF)
    assert out.columns == columns and {r["doc_id"]: r["text"] for r in out.collect()} == masked

    plain = Tokenizer.from_file(path("word_bpe_49k.json"))
    want = {}
    for i in kept:
        ids = np.array([*plain.encode(masked[i], add_special_tokens=False).ids, 0], "<u4")
        for k in range(math.ceil(len(ids) / 2048)):
            want[i, k] = zlib.crc32(ids[2048 * k : 2048 * k + 2048].tobytes())
    got = corpus_pipeline.run(spark, SF).collect()
    assert {(r["doc_id"], r["piece"]): r["ids_crc32"] for r in got} == want and len(got) == len(want)


def test_odd_and_empty_tables(spark):
    for rows in (documents(), []):
        docs = frame(spark, rows, extra=False)
        for name, stage in corpus_pipeline.STAGES:
            out = stored(stage(spark, docs, SF))
            assert name == "best_fit_packing" or out.columns == docs.columns
            docs = out if name != "best_fit_packing" else docs
        assert out.count() >= min(1, len(rows))
