"""Work that is done once, however often a formula names it."""

import hashlib
import re

from pyspark.sql import functions as F

from spanloom.catalog import derived, queries
from spanloom.functions import markup, spans, text
from spanloom.operators import agreement, embedding, joins, reflection, stats

SPAN = "array<struct<id:string,start:int,end:int,text:string,label:string,implicit:boolean>>"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_f1_makes_keys_and_counts_once(spark):
    row = lambda *places: [(f"T{i}", p, p + 2, "ab", "L", False) for i, p in enumerate(places)]
    df = spark.createDataFrame([(row(1, 3), row(1, 5, 5)), ([], []), (row(1), []), (None, row(1))], f"a {SPAN}, b {SPAN}")
    for profile, best in (("consistency", 0.5), ("metric", 0.5), ("batch", 0.5), ("gold", 0.5)):
        out = df.select(spans.span_f1(F.col("a"), F.col("b"), profile).alias("f"))
        assert plan(out).count("array_intersect") == 1
        assert [r.f for r in out.collect()][:3] == [best, 0.0 if profile == "metric" else 1.0, 0.0]
    sig = df.select(agreement._sig_f1(agreement.batch_signature(F.col("a")), agreement.batch_signature(F.col("b"))).alias("f"))
    assert plan(sig).count("array_intersect") == 1 and [r.f for r in sig.collect()][:3] == [0.5, 1.0, 0.0]


def test_marks_are_placed_across_blocks_without_their_texts(spark, monkeypatch):
    scan, kinds = markup.chunked_scan, []
    monkeypatch.setattr(markup, "chunked_scan", lambda items, start, step, kind, **more: kinds.append(kind) or scan(items, start, step, kind, **more))
    words = [f"w{i % 90}é" for i in range(300)]
    t = "心 " + " ".join(words)
    asked = [w if i % 7 else f"missing{i}" for i, w in enumerate(words)]
    df = spark.createDataFrame([(t, " ".join(f"[{w}]{{L}}" for w in asked) + " [!x]{L}")], "t string, m string")
    out = df.select(markup.markup_to_spans(F.col("t"), F.col("m")).alias("s"))
    pos, want = 0, []
    for w in asked:
        at = t.find(w, pos)
        want.append((at, at + len(w)) if at >= 0 else (-1, -1))
        pos = at + len(w) if at >= 0 else pos
    assert [(s.start, s.end) for s in out.first().s] == [*want, (-1, -1)]
    assert [(s.id, s.text) for s in out.first().s] == [*((f"s{i}", w) for i, w in enumerate(asked)), ("s300", "x")]
    assert kinds == ["int"]
    none = spark.createDataFrame([("x", None), (None, "[a]{L}")], "t string, m string").select(markup.markup_to_spans(F.col("t"), F.col("m")).alias("s")).collect()
    assert none[0].s == [] and [(s.start, s.text) for s in none[1].s] == [(-1, "a")]


def test_spans_are_relocated_to_their_first_place(spark):
    rows = [("T1", 9, 11, "心b", "L", False), ("", 0, 1, "b", "L", False), ("T3", 5, 6, "b", "L", False), ("T4", -1, -1, "b", "L", True), ("T5", -1, -1, "none", "L", False), ("T6", 4, 8, "none", "L", False)]
    df = spark.createDataFrame([("😀a心b b", rows), (None, rows[:1]), ("x", None), ("x", [])], f"t string, s {SPAN}")
    out = df.select(markup.relocate_spans(F.col("s"), F.col("t")).alias("r"))
    got = [None if r.r is None else [(s.id, s.start, s.end) for s in r.r] for r in out.collect()]
    assert got == [[("T1", 2, 4), ("T2", 3, 4), ("T3", 3, 4), ("T4", -1, -1), ("T6", 4, 8)], [("T1", 9, 11)], None, []]


def test_spans_are_looked_for_outside_the_expression(spark):
    """A text meets its words once, not four times a span; a condition derived from the result does not take the search along."""
    span = lambda i, w, implicit=False: (f"T{i}", 7, 8, w, "L", implicit)
    rows = [(1, "😀 b ab", [span(0, "ab"), span(1, None), span(2, ""), span(3, "x"), span(4, "b", None)]), (2, "😀 b ab", [span(0, "b")]), (3, None, [span(0, "b")]), (4, "b", []), (5, "b", None), (6, "", [span(0, "b"), span(1, "")])]
    df = spark.createDataFrame(rows, f"i int, t string, s {SPAN}").coalesce(1).select("i", markup.relocate_spans(F.col("s"), F.col("t")).alias("r"))
    assert "locate(" not in plan(df) and plan(df).count("first_places") == 1
    got = [(r.i, r.s.id, r.s.start, r.s.end) for r in df.select("i", F.explode("r").alias("s")).collect()]
    assert got == [(1, "T0", 4, 6), (1, "T1", 7, 8), (1, "T2", 0, 0), (1, "T3", 7, 8), (1, "T4", 2, 3), (2, "T0", 2, 3), (3, "T0", 7, 8), (6, "T0", 7, 8), (6, "T1", 0, 0)]


def test_firsts_without_case_are_found_by_sorting(spark):
    df = spark.createDataFrame([(["b ", "A", "", "a", None, "B", "c", "A"],), ([],), (None,)], "x array<string>")
    out = df.select(text.dedupe_keep_order(F.col("x"), ignore_case=True).alias("u"))
    assert [r.u for r in out.collect()] == [["b", "A", "c"], [], None]
    assert "array_position" not in plan(out)


def test_long_words_are_the_long_ones_of_all_words(spark):
    rows = ["", "short 心abcdefgh12心 longword_1, x longer_words", "abcdefgh", "  abcdefgh é", None, "😀 abcdefghi😀jklmnopqr"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string")
    both = df.select("i", text.tokenize_words(F.col("t"), lower=False, least=8).alias("a"), F.filter(text.tokenize_words(F.col("t"), lower=False), lambda w: F.length(w["text"]) >= 8).alias("b"))
    assert all(r.a == r.b for r in both.collect())


def test_predictions_are_made_once_for_all_that_reads_them(spark, folder, monkeypatch):
    words = "pneumonia treatment considerations heart failure respiratory "
    spark.createDataFrame([(i, words * (1 + i % 3), "en", "src3") for i in range(40)], "doc_id long, text string, lang string, source string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, i % 2, i % 3 // 2) for i in range(0, 40, 3)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    made, make = [], derived.predictions
    monkeypatch.setattr(derived, "predictions", lambda *a: made.append(1) or make(*a))
    for name in ("route_distribution", "export_filters", "example_pool", "experiment_metrics", "review_options", "failure_memory"):
        made.clear()
        if name == "failure_memory":
            spark.createDataFrame([(1, "2024-01-01 00:00:00", 2, "signup", 1.0, '{"k": 10}')], "event_id long, ts string, user_id long, event_type string, value double, props string").selectExpr(
                "event_id", "CAST(ts AS timestamp) AS ts", "user_id", "event_type", "value", "props").write.parquet(f"{folder}/events.parquet")
        out = queries()[name](spark, folder)
        assert len(made) == 1 and out.count() > 0, name
    routes = {r.route: r.task_count for r in queries()["route_distribution"](spark, folder).collect()}
    assert sum(routes.values()) == 40


def test_hashed_buckets_equal_plain_counts_and_repeated_keys_add_up(spark):
    rows = [(1, "The  heart 心 the"), (2, ""), (3, None), (4, "a"), (1, "café 😀 x"), (None, "no key")]
    df = spark.createDataFrame(rows, "k long, text string")
    out = embedding.hashed_buckets(df, "k")
    assert "explode" not in plan(out)  # no row per feature
    want = {}
    for k, t in rows:
        low = (t or "").lower()
        tokens = re.findall("[a-z0-9_]+|[一-鿿]", low)
        packed = f" {' '.join(low.split())} "
        grams = [("w", w) for w in tokens] + [("w", f"{a} {b}") for a, b in zip(tokens, tokens[1:])]
        grams += [("c", packed[i : i + n]) for n in (3, 4, 5) for i in range(len(packed) - n + 1)]
        for kind, g in grams:
            m = hashlib.md5(f"{kind}:{g}".encode()).hexdigest()
            at = want.setdefault((k, int(m[:8], 16) % 384), {"w": 0, "c": 0})
            at[kind] += 1 if m[31] < "8" else -1
    assert {(r.k, r.bucket): {"w": r.words, "c": r.chars} for r in out.collect()} == want


def test_texts_of_a_key_are_counted_together_without_a_shuffle_of_buckets(spark):
    """More texts of a key than a worker takes at once, some without features."""
    rows = [(k, "a heart") for k in (1, 2, None) for _ in range(300)] + [(3, ""), (3, "x"), (4, "")]
    out = embedding.hashed_buckets(spark.createDataFrame(rows, "k long, text string"), "k", packed=True)
    assert plan(out).count("Aggregate") == 0
    got = {r.k: r.buckets for r in out.collect()}
    one = embedding.hashed_buckets(spark.createDataFrame([(1, "a heart"), (3, "x")], "k long, text string"), "k").collect()
    single = {k: sorted((r.bucket, r.words, r.chars) for r in one if r.k == k) for k in (1, 3)}
    assert set(got) == {1, 2, 3, None} and [tuple(b) for b in got[3]] == single[3]
    for k in (1, 2, None):
        assert [tuple(b) for b in got[k]] == [(b, 300 * w, 300 * c) for b, w, c in single[1]]


def test_candidates_of_other_routes_are_held_back_before_the_shuffle(spark):
    ids = lambda rows: sorted((r.sample_id or "", r.candidate_id) for r in rows.collect())
    c = spark.createDataFrame([(f"s{k % 2000}" if k % 7 else None, f"c{k}", "a text", [("T", 0, 1, "a", "L", False)]) for k in range(6000)], f"sample_id string, candidate_id string, text string, spans {SPAN}")
    high = spark.createDataFrame([(f"s{k}", "high" if k % 100 == 0 else "low") for k in range(2000)] + [(None, "high")], "sample_id string, route string")
    near, sure = joins.may_be_among(c, high.where("route = 'high'"), "sample_id"), c.join(high.where("route = 'high'"), "sample_id", "left_semi")
    assert near.columns == c.columns and set(ids(sure)) <= set(ids(near)) and near.where("sample_id IS NOT NULL").count() < 2 * sure.count()
    s = spark.createDataFrame([(f"s{k}", "a text", [("T", 0, 1, "a", "L", False)] if k < 3 else []) for k in range(2000)], f"id string, text string, spans {SPAN}")
    pool = joins.stats_samples(s, c, high)
    assert "bits_" in plan(pool)
    assert sorted(r.id for r in pool.collect()) == sorted(["s0", "s1", "s2"] + [f"{a}:{b}" for a, b in ids(sure)])


def test_words_and_spans_meet_inside_their_row(spark):
    span = lambda a, b, implicit=False: ("T", a, b, "x", "L", implicit)
    rows = [("a", "Heart failure care rises", [span(0, 13), span(None, 3, True)]), ("a", "Heart failure care rises", [span(0, 13)]), ("b", "心x care", []), ("c", None, [span(0, 1)]), ("d", "lost", None), (None, "care", [span(0, None)])]
    s = spark.createDataFrame(rows, f"id string, text string, spans {SPAN}")
    known = stats.token_label_stats(s, window=1)
    assert "Window" not in plan(known)
    assert {r.token: (r.entity_count, r.context_count, r.other_count, r.total) for r in known.collect()} == {
        "heart": (2, 0, 0, 2), "failure": (2, 0, 0, 2), "care": (0, 1, 3, 4), "rises": (0, 0, 2, 2), "心": (0, 0, 1, 1), "x": (0, 0, 1, 1)}
    c = spark.createDataFrame([("a", "c1", [span(6, 18)]), ("a", "c2", [span(0, 5), span(14, 18)]), ("a", "c3", None), ("b", "c1", []), (None, "c1", []), ("z", "c1", [])], f"sample_id string, candidate_id string, spans {SPAN}")
    found = reflection.reflection_items(s.where("text IS NOT NULL"), c, known.where("token <> '心'"))
    assert "Window" not in plan(found)
    assert sorted((r.id, r.candidate_id, r["rank"], r.item_type, r.token, r.start, r.end) for r in found.collect()) == [
        ("a", "c1", 1, "possible_false_negative", "heart", 0, 5), ("a", "c1", 2, "boundary_token", "care", 14, 18),
        ("a", "c2", 1, "possible_false_negative", "failure", 6, 13), ("a", "c2", 2, "boundary_token", "care", 14, 18), ("b", "c1", 1, "unseen_token", "心", 0, 1)]
    seen = spark.createDataFrame([("care", 0.1, 0.4), ("heart", 0.0, 0.0), ("failure", 0.0, 0.0), ("rises", 0.2, 0.3)], "token string, entity_p double, context_p double")
    edges = reflection.reflection_items(s.where("text IS NOT NULL"), c, seen).where("id = 'a'")
    assert sorted((r.candidate_id, r["rank"], r.item_type, r.token) for r in edges.collect()) == [("c1", 1, "boundary_token", "care"), ("c2", 1, "boundary_token", "care")]
