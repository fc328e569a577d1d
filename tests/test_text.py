import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanloom.functions import core, markup, responses, text, vectors
from spanloom.operators.corpus import chunk_text

SAMPLES = ["", "Heart failure.", "心脏 fails 3.5 times; yes!\nnew  line", "😀 a心b_1, x", "word " * 300 + "end.", "no end\n\n...\n", "　tab\tand\xa0gap ", "a" * 700 + "。" + "b" * 400]


def values(spark, rows, expr):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string")
    return [r[1] for r in sorted(df.select("i", expr(F.col("t")).alias("v")).collect())]


def plain_tokens(t, pattern):
    return [(m.group(0), m.start(), m.end()) for m in re.finditer(pattern, t)]


def test_tokens_match_plain(spark):
    got = values(spark, SAMPLES, text.tokenize)
    assert [[tuple(x) for x in g] for g in got] == [plain_tokens(t, r"[A-Za-z0-9_]+|[一-鿿]|[^\s]") for t in SAMPLES]
    got = values(spark, SAMPLES, lambda c: text.tokenize_words(c, lower=False))
    assert [[tuple(x) for x in g] for g in got] == [plain_tokens(t, r"[A-Za-z0-9_]+|[一-鿿]") for t in SAMPLES]


def test_tokens_match_plain_on_random_text(spark):
    found = []

    @settings(max_examples=60, deadline=None, suppress_health_check=list(HealthCheck))
    @given(st.text(alphabet="ab_1 .\n心脏😀é;\t ", max_size=120))
    def collect(t):
        found.append(t)

    collect()
    got = values(spark, found, text.tokenize)
    assert [[tuple(x) for x in g] for g in got] == [plain_tokens(t, r"[A-Za-z0-9_]+|[一-鿿]|[^\s]") for t in found]


def test_sentences(spark):
    assert values(spark, ["A b. C d!\n\n...\n好。坏？"], text.split_sentences) == [["A b.", "C d!", "...", "好。", "坏？"]]


def test_shorten_and_key_sentences(spark):
    assert values(spark, ["a  b\nc", "abcdef ghij"], lambda c: text.shorten(c, 7)) == ["a b c", "abcdef…"]
    assert values(spark, ["一。 二！三；四", " x. y "], text.key_sentences) == [["一。", "二！", "三；"], ["x. y"]]


def test_half_even_is_binary(spark):
    xs = [0.00625, 0.125, 0.91875, 0.5, 2.675, 1 / 3, 0.00005, 1.00015, -0.125, 0.0]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double")
    rows = sorted(df.select("i", *[core.half_even(F.col("x"), d).alias(f"d{d}") for d in (2, 4)]).collect())
    assert [r.d4 for r in rows] == [round(x, 4) for x in xs] and [r.d2 for r in rows] == [round(x, 2) for x in xs]


def test_dedupe_and_units(spark):
    df = spark.createDataFrame([([" A", "b", "a", "", "B "],)], "x array<string>")
    assert df.select(text.dedupe_keep_order(F.col("x"))).first()[0] == ["A", "b", "a", "B"]
    assert df.select(text.dedupe_keep_order(F.col("x"), ignore_case=True)).first()[0] == ["A", "b"]


def test_markup(spark):
    src = "risk of heart failure and heart failure"
    m = "[heart failure]{Term} [!cause]{Why} [heart failure]{Term} [lost]{X}"
    df = spark.createDataFrame([(src, m)], "t string, m string")
    spans = df.select(markup.markup_to_spans(F.col("t"), F.col("m"))).first()[0]
    assert [(s.id, s.start, s.end, s.text, s.implicit) for s in spans] == [("s0", 8, 21, "heart failure", False), ("s1", -1, -1, "cause", True), ("s2", 26, 39, "heart failure", False), ("s3", -1, -1, "lost", False)]
    back = df.select(markup.spans_to_markup(markup.markup_to_spans(F.col("t"), F.col("m")))).first()[0]
    assert back == m
    issues = values(spark, ["", "[a](b)", "none", "[a]{ }", "[! ]{L}", "[ ]{L}", "[a]{L}"], markup.markup_issue)
    assert issues == ["blank", "old_format", "no_span", "empty_label", "empty_implied", "empty_text", None]


def test_responses(spark):
    ok = '{"text": "a b", "annotation": "[b]{L}", "explanation": "e", "confidence": 1.7}'
    raw = [ok, f"```json\n{ok}\n```", ok[:-3], '{"text": "a"}', ok.replace('"e"', '" "'), ok.replace("[b]{L}", "")]
    parsed = values(spark, raw, responses.parse_response)
    assert [p.warning for p in parsed] == [None, None, "invalid_json", "missing_fields", "blank_explanation", None]
    assert [(s.start, s.end) for s in parsed[1].spans] == [(2, 3)] and parsed[5].spans == []
    assert values(spark, raw, lambda c: responses.confidence_of(c, 0.3))[:3] == [1.0, 1.0, 0.3]


def plain_chunks(t, size, overlap):
    t = t.strip()
    if len(t) <= size:
        return [t]
    out, start, low = [], 0, max(80, size // 2)
    while start < len(t):
        if len(t) - start <= size:
            out.append(t[start:].strip())
            break
        stops = [i + 1 for i in range(start + low, start + size) if t[i] in "。！？!?；;\n"]
        end = stops[-1] if stops else start + size
        out.append(t[start:end].strip())
        start = max(end - overlap, start + 1)
    return [c for c in out if c]


def test_chunks(spark):
    docs = SAMPLES + ["One two; three! " * 90, ("x" * 119 + "\n") * 12]
    for size, overlap in ((200, 40), (100, 79), (520, 80)):
        assert values(spark, docs, lambda c: chunk_text(c, size, overlap)) == [plain_chunks(t, size, overlap) for t in docs]


def test_hash_vectors(spark):
    import hashlib

    import numpy as np

    def plain(t):
        v, low = np.zeros(384), t.lower()
        toks = re.findall(r"[A-Za-z0-9_]+|[一-鿿]", low)
        feats = [("w:" + " ".join(toks[i : i + n]), 1.0) for n in (1, 2) for i in range(len(toks) - n + 1)]
        packed = re.sub(r"\s+", " ", low).strip()
        if packed:
            p = f" {packed} "
            feats += [("c:" + p[i : i + n], 0.55) for n in (3, 4, 5) for i in range(len(p) - n + 1)]
        for f, w in feats:
            raw = int.from_bytes(hashlib.blake2b(f.encode(), digest_size=8).digest(), "big")
            v[raw % 384] += -w if raw >> 63 else w
        return v / (np.linalg.norm(v) or 1)

    texts = ["heart failure care", "cardiac care", "", "心脏 x"]
    for got, t in zip(values(spark, texts, vectors.hash_embed_udf()), texts):
        assert np.allclose(got, plain(t), atol=1e-5)


def test_segments(spark):
    got = values(spark, ["Concept description: x\nmore\n\nBoundary rules:\n- a\nLabels: B"], text.segment_text)[0]
    assert [(s.id, s.kind, s.mutable) for s in got] == [("seg-01-task_definition", "task_definition", True), ("seg-02-boundary_rules", "boundary_rules", True), ("seg-03-label_schema", "label_schema", False)]
    assert got[0].text == "Concept description: x\nmore"


def test_strip_protocol(spark):
    assert values(spark, ["Keep\n- Labels: A\n\n\nOutput format: x\nAlso [span]{T}\nend"], text.strip_protocol_lines) == ["Keep\n\nend"]


def test_headings_are_compared_without_case(spark):
    df = spark.createDataFrame([("LABELS: a\nx\nMy Part\ny",)], "t string")
    kinds = lambda h=None: [s.kind for s in df.select(text.segment_text(F.col("t"), h).alias("s")).first().s]
    assert kinds() == ["label_schema"] and kinds([("my part", "one"), ("My", "two")])[-1] == "one"
