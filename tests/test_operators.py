from difflib import SequenceMatcher

from pyspark.sql import functions as F

from spanloom.functions import spans
from spanloom.operators import agreement, dedup, joins, leakage, ranking, reflection, retrieval, review, runs, stats
from spanloom.schema import SPAN_DDL
from spanloom.sources.positions import with_position

CAND = f"sample_id string, candidate_id string, run bigint, spans array<{SPAN_DDL}>, model_confidence double"


def sp(start, end, text, label="Term", implicit=False):
    return ("", start, end, text, label, implicit)


def test_consistency(spark):
    hf, other = sp(8, 21, "heart failure"), sp(0, 4, "risk")
    rows = [("a", "c1", 1, [hf], 0.9), ("a", "c2", 2, [hf], 0.8), ("b", "c1", 1, [hf], None), ("b", "c2", 2, [other], None), ("c", "c1", 1, [], 0.5), ("d", "c1", 1, [hf, other], 0.7), ("d", "c2", 2, [hf], 0.7)]
    got = {r.sample_id: r for r in agreement.consistency_scores(spark.createDataFrame(rows, CAND)).collect()}
    assert (got["a"].route, got["a"].pairwise_span_f1, got["a"].exact_match_rate, got["a"].average_model_confidence) == ("high", 1.0, 1.0, 0.85)
    assert (got["b"].route, got["b"].pairwise_span_f1, got["b"].average_model_confidence, got["b"].uncertainty_score) == ("low", 0.0, None, 1.0)
    assert got["c"].pairwise_span_f1 == 1.0 and got["c"].route == "medium"
    assert got["d"].pairwise_span_f1 == round(2 / 3, 4) and got["d"].exact_match_rate == 0.5


def test_consistency_of_a_hot_sample_equals_all_pairs(spark):
    import itertools

    shapes = [[sp(i, i + 2, "ab")] if i % 3 else [sp(i, i + 2, "ab"), sp(50, 52, "zz")] for i in range(12)]
    rows = [("hot", f"c{n}", n, shapes[n % 12], 0.8) for n in range(240)]

    def f1(a, b):
        a, b = {x[1:] for x in a}, {x[1:] for x in b}
        o = len(a & b)
        return round(2 * (o / len(a)) * (o / len(b)) / (o / len(a) + o / len(b)), 4) if o else 0.0

    pairs = [f1(a[3], b[3]) for a, b in itertools.combinations(rows, 2)]
    got = agreement.consistency_scores(spark.createDataFrame(rows, CAND)).first()
    assert got.pairwise_span_f1 == round(sum(pairs) / len(pairs), 4) and got.candidate_count == 240 and got.exact_match_rate == round(20 / 240, 4)


def test_consensus_ties_take_the_smallest(spark):
    p = [("t", "p1", 1, [sp(5, 7, "b")], 0.9, 0.0), ("t", "p2", 2, [sp(0, 2, "a")], 0.9, 0.0)]
    df = spark.createDataFrame(p, f"task_id string, prediction_id string, run bigint, spans array<{SPAN_DDL}>, score double, rule_risk double")
    got = {r.prediction_id: r.span_f1_to_consensus for r in agreement.consensus_candidates(df).collect()}
    assert got == {"p1": 0.0, "p2": 1.0}
    assert agreement.consensus_scores(df).first().score == round(0.5 * 0.5 + 0.5 * 0.2 + 0.9 * 0.2 + 0.1, 4)
    assert review.best_predictions(df).first().best_prediction_id == "p1"


def test_token_roles_and_reflection(spark):
    s = spark.createDataFrame([("a", "risk of heart failure rises", [sp(8, 21, "heart failure")])], f"id string, text string, spans array<{SPAN_DDL}>")
    got = {r.token: (r.entity_count, r.context_count, r.other_count) for r in stats.token_label_stats(s, window=1).collect()}
    assert got == {"risk": (0, 0, 1), "of": (0, 1, 0), "heart": (1, 0, 0), "failure": (1, 0, 0), "rises": (0, 1, 0)}
    known = stats.token_label_stats(s)
    c = spark.createDataFrame([("b", "c1", 1, [sp(0, 5, "of th")], 0.9)], CAND)
    t = spark.createDataFrame([("b", "of the heart", [])], f"id string, text string, spans array<{SPAN_DDL}>")
    items = [(r.item_type, r.token) for r in reflection.reflection_items(t, c, known).orderBy("rank").collect()]
    assert items == [("possible_false_negative", "heart"), ("boundary_token", "of")]
    none = [(r.item_type, r.token) for r in reflection.reflection_items(t, c, known.where("false")).orderBy("rank").collect()]
    assert none == [("unseen_token", "heart")]


def test_retrieval(spark):
    s = spark.createDataFrame([("near", "heart failure treatment"), ("q", "heart failure care"), ("far", "stone bridge")], "id string, text string")
    t = retrieval.token_sets(s)
    got = sorted(tuple(r)[:4] for r in retrieval.contrastive_select(t.where("id = 'q'"), t, 1, 1).collect())
    assert got == [("q", "boundary", "far", 0.0), ("q", "similar", "near", 0.5)]
    bank = t.withColumn("hard", F.col("id") == "far")
    picks = [r.example_id for r in retrieval.select_examples(t.where("id = 'q'"), bank, 2).orderBy("rank").collect()]
    assert picks == ["q", "far"]


def test_leakage(spark):
    corpus = spark.createDataFrame([("1", "acute cardiac insufficiency observed", "source_text"), ("1", "cardiac insufficiency", "gold_span")], "source_id string, text string, source_type string")
    fp = leakage.fingerprint(corpus, ["observed"])
    texts = spark.createDataFrame([("gold", "mark cardiac insufficiency"), ("soft", "acute things"), ("ok", "observed label")], "id string, text string")
    assert {r.id: r.severity for r in leakage.leak_check(texts, fp).collect()} == {"gold": "critical_leak", "soft": "soft_leak", "ok": "clean"}


def test_dedup_equals_brute_force(spark):
    import random

    rnd = random.Random(5)
    base = [" ".join(rnd.choice("lorem ipsum dolor sit amet, Consectetur kx qz Adipiscing".split()) for _ in range(rnd.choice([6, 30, 80]))) for _ in range(12)]

    def noisy(t, share):
        return "".join(c if rnd.random() > share else rnd.choice("xyzkQ ") for c in t)

    texts = base + [noisy(rnd.choice(base), rnd.choice([0.01, 0.03, 0.05, 0.09])) for _ in range(70)] + base[:3]
    rnd.shuffle(texts)
    rows = [(i, i // 2, i, t) for i, t in enumerate(texts)]
    accepted, verdict, task, waiting, nearest = [], {}, -1, [], {}
    for i, k, _, t in rows:
        if k != task:
            accepted, waiting, task = accepted + waiting, [], k
        best = max((SequenceMatcher(None, t, o).ratio() for o in accepted), default=0.0)
        verdict[i], nearest[i] = best < 0.92, None if best < 0.92 else round(best, 9)
        if verdict[i]:
            waiting.append(t)
    got = dedup.greedy_dedup(spark.createDataFrame(rows, "id int, task int, at int, text string"), block=16)
    rows = got.collect()
    assert {r.id: r.accepted for r in rows} == verdict and not all(verdict.values())
    assert {r.id: r.max_similarity and round(r.max_similarity, 9) for r in rows} == nearest


def test_positions_and_ranks(spark):
    df = spark.range(0, 1000, 1, 7).select(F.col("id"), (F.col("id") % 3 == 0).alias("hot"))
    rows = with_position(df, [F.desc("id")]).collect()
    assert all(r.position == 1000 - r.id for r in rows)
    ranked = ranking.rank_in_group(df, ["hot"], ["id"])
    ids = {hot: sorted(i for i in range(1000) if (i % 3 == 0) is hot) for hot in (True, False)}
    assert sorted(map(tuple, ranked.collect())) == sorted((i, hot, k + 1) for hot, group in ids.items() for k, i in enumerate(group))


def test_option_letters_follow_ranks(spark):
    reviews = spark.createDataFrame([("r1", "t1", False), ("r2", "t2", False)], "review_id string, task_id string, hard_example boolean")
    predictions = spark.createDataFrame([("t1", f"p{k}", k, [sp(k, k + 1, "x")]) for k in (2, 5)] + [("t3", "q", 1, [])], f"task_id string, prediction_id string, run int, spans array<{SPAN_DDL}>")
    tasks = spark.createDataFrame([("t1", [], None)], f"id string, spans array<{SPAN_DDL}>, source_pool string")
    rows = [(r, "accept", o, None, None, False, "", False) for r, o in (("r1", "B"), ("r1", "C"), ("r2", "A"), ("r9", "A"))]
    decisions = spark.createDataFrame(rows, f"review_id string, decision string, selected_option_id string, manual_spans array<{SPAN_DDL}>, note string, hard_example boolean, error_type string, promote_to_gold boolean")
    assert {r.option_id: r.position for r in review.review_options(reviews.where("review_id = 'r1'"), predictions).collect()} == {"A": 1, "B": 2, "manual": 6}
    got = {(r.review_id, r.answer): (r.selected_candidate_id, r.error) for r in review.apply_decisions(reviews, decisions, tasks, predictions).collect()}
    assert got == {("r1", "B"): ("p5", None), ("r1", "C"): (None, "invalid_option"), ("r2", None): (None, "unknown_task"), ("r9", None): (None, "unknown_review")}


def test_hot_key_is_summed_in_parts(spark):
    """With one hot sample the join of its answers and their sum use more than one task."""
    rows = [("hot", f"c{k}", k, [sp(k, k + 1, "x")], 0.9) for k in range(120)] + [(f"s{k}", "c", 1, [], 0.5) for k in range(20)]
    df = spark.createDataFrame(rows, CAND)
    figures = agreement.consistency_scores(df)
    assert {r.sample_id: r.candidate_count for r in figures.collect()}["hot"] == 120
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    parts = agreement._parts(agreement.answer_pairs(agreement.signature_groups(df)).select("sample_id", "l_sig"), "sample_id", "l_sig").where("sample_id = 'hot'")
    tasks = {r[0] for r in parts.select(F.spark_partition_id()).collect()}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(tasks) > 1


def test_span_difference_keeps_fields_apart(spark):
    a = [sp(0, 1, "x\x1fy"), sp(2, 3, "z", None)]
    df = spark.createDataFrame([(a, [sp(0, 1, "x")])], f"a array<{SPAN_DDL}>, b array<{SPAN_DDL}>")
    got = df.select(spans.span_difference(F.col("a"), F.col("b")).alias("d"), F.size(spans.span_keys(F.col("a"), "gold")).alias("n"), F.size(spans.signature_keys(spans.signature(F.col("a"), "gold"))).alias("m")).first()
    assert [(s.start, s.text, s.label) for s in got.d] == [(0, "x\x1fy", "Term"), (2, "z", None)] and got.n == got.m == 2


def test_running_values_do_not_depend_on_buckets(spark):
    e = spark.sql("SELECT id AS event_id, id % 3 AS run_id, timestamp_seconds(id * 700) AS ts, double((id * 37) % 11) AS loss, id % 5 AS pass_count, id AS tokens, 'call_retried' AS event_type FROM range(300)")
    a = sorted(map(tuple, runs.running_best(e, bucket="hour").select("event_id", "best_loss", "best_pass_count", "total_tokens", "retry_count").collect()))
    b = sorted(map(tuple, runs.running_best(e, bucket="year").select("event_id", "best_loss", "best_pass_count", "total_tokens", "retry_count").collect()))
    assert a == b and a[-1][4] == 100


def test_example_pool_prefers_the_project_row(spark):
    t = spark.createDataFrame([("a", "x", [sp(0, 1, "x")], "auto_accept", 0.9, False, "auto"), ("b", "y", [sp(0, 1, "y")], "review", 0.1, False, "review")],
                              f"id string, text string, spans array<{SPAN_DDL}>, route string, score double, promote_to_gold boolean, source_pool string")
    g = spark.createDataFrame([(["a", "b", "z"],)], "task_ids array<string>")
    assert {r.id: r.source_pool for r in joins.example_pool(g, t).collect()} == {"a": "high_confidence", "b": "gold"}


def test_plans_have_no_cartesian_product(spark):
    c = spark.createDataFrame([("a", "c1", 1, [sp(0, 1, "x")], 0.9)], CAND)
    for df in (agreement.consistency_scores(c), leakage.leak_check(spark.createDataFrame([("a", "b")], "id string, text string"), leakage.fingerprint(spark.createDataFrame([("1", "t", "source_text")], "source_id string, text string, source_type string")))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "Python" not in plan
