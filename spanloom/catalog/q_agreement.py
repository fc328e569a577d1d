"""Agreement and consensus queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import agreement as ag
from .derived import candidates
from .registry import cte, query, rnd, with_

cte("csig", """
SELECT c.sample_id, c.run, c.conf, coalesce(k.keys, []) AS keys
FROM runs3 c LEFT JOIN (
  SELECT sample_id, run, list(DISTINCT concat_ws('~', st, en, txt, label, implicit)) AS keys FROM cspans GROUP BY ALL
) k ON c.sample_id = k.sample_id AND c.run = k.run
""", ["runs3", "cspans"])
cte("cpairs", f"""
SELECT sample_id, CASE WHEN na = 0 AND nb = 0 THEN 1e0 WHEN na = 0 OR nb = 0 OR tp = 0 THEN 0e0
  ELSE {rnd('2e0 * (tp::DOUBLE/na) * (tp::DOUBLE/nb) / ((tp::DOUBLE/na) + (tp::DOUBLE/nb))')} END AS f1, run_a, run_b
FROM (SELECT a.sample_id, a.run AS run_a, b.run AS run_b, len(a.keys) AS na, len(b.keys) AS nb, len(list_intersect(a.keys, b.keys)) AS tp
      FROM csig a JOIN csig b ON a.sample_id = b.sample_id AND a.run < b.run)
""", ["csig"])
cte("consist0", f"""
SELECT s.sample_id, n AS candidate_count, {rnd('f.u / (f.p * 1e4)')} AS pairwise_span_f1, {rnd('exact_n::DOUBLE / n')} AS exact_match_rate,
       CASE WHEN cn > 0 THEN {rnd('cu / (cn * 1e4)')} END AS average_model_confidence
FROM (SELECT a.sample_id, count(*) AS n, sum(CASE WHEN len(a.keys) = len(f.keys) AND len(list_intersect(a.keys, f.keys)) = len(f.keys) THEN 1 ELSE 0 END)::BIGINT AS exact_n,
             sum(CAST(round(a.conf * 10000) AS BIGINT))::DOUBLE AS cu, count(a.conf) AS cn
      FROM csig a JOIN csig f ON a.sample_id = f.sample_id AND f.run = 1 GROUP BY 1) s
JOIN (SELECT sample_id, sum(CAST(round(f1 * 10000) AS BIGINT))::DOUBLE AS u, count(*) AS p FROM cpairs GROUP BY 1) f ON s.sample_id = f.sample_id
""", ["csig", "cpairs"])
cte("consist", f"""
SELECT *, CASE WHEN average_model_confidence IS NULL THEN {rnd('1 - pairwise_span_f1')}
            ELSE {rnd('(1 - pairwise_span_f1) * 0.7e0 + (1 - average_model_confidence) * 0.3e0')} END AS uncertainty_score,
       CASE WHEN pairwise_span_f1 >= 0.95e0 AND exact_match_rate >= 0.8e0 AND (average_model_confidence IS NULL OR average_model_confidence >= 0.7e0) THEN 'high'
            WHEN pairwise_span_f1 >= 0.6e0 THEN 'medium' ELSE 'low' END AS route
FROM consist0
""", ["consist0"])


@query("consistency_scores", with_("consist") + "SELECT * FROM consist")
def consistency_scores(spark, d):
    return ag.consistency_scores(candidates(spark, d))


@query("consistency_pairs", with_("cpairs") + "SELECT f1 AS span_f1, count(*) AS pair_count FROM cpairs GROUP BY 1")
def consistency_pairs(spark, d):
    both = ag.pairwise_f1(ag.signature_groups(candidates(spark, d)))
    return both.groupBy(F.col("f1").alias("span_f1")).agg(F.sum("weight").alias("pair_count"))


# ---------------------------------------------------------------- overlap profiles

from ..functions import spans as sp  # noqa: E402
from ..functions.core import half_even  # noqa: E402
from ..operators import review as rv  # noqa: E402
from .derived import decisions, gold_sets, guidelines, jobs, predictions, reviews, routed_predictions, routed_tasks, samples, table  # noqa: E402


def _profile_sql(key: str, formula: str) -> str:
    return with_("cspans", "runs3", "gold") + f"""
, g AS (SELECT id, list(DISTINCT {key}) AS keys FROM gold GROUP BY 1), p AS (SELECT sample_id, run, list(DISTINCT {key}) AS keys FROM cspans GROUP BY 1, 2),
n AS (SELECT r.sample_id, r.candidate_id, len(coalesce(g.keys, [])) AS ng, len(coalesce(p.keys, [])) AS np, len(list_intersect(coalesce(g.keys, []), coalesce(p.keys, []))) AS tp
      FROM runs3 r LEFT JOIN g ON r.sample_id = g.id LEFT JOIN p ON r.sample_id = p.sample_id AND r.run = p.run)
SELECT sample_id, candidate_id, {formula} FROM n"""


def _against_gold(spark, d):
    gold = samples(spark, d).select(F.col("id").alias("sample_id"), F.col("spans").alias("gold_spans"))
    return candidates(spark, d).join(gold, "sample_id")


_PR = "(tp::DOUBLE/np)", "(tp::DOUBLE/ng)"
_F1 = "2e0 * (tp::DOUBLE/ng) * (tp::DOUBLE/np) / ((tp::DOUBLE/ng) + (tp::DOUBLE/np))"


@query("span_metrics", _profile_sql("concat_ws('~', st, en, label)", f"""
CASE WHEN np > 0 THEN {rnd('tp::DOUBLE/np')} ELSE 0e0 END AS precision, CASE WHEN ng > 0 THEN {rnd('tp::DOUBLE/ng')} ELSE 0e0 END AS recall,
CASE WHEN tp > 0 THEN {rnd("2e0 * (tp::DOUBLE/np) * (tp::DOUBLE/ng) / ((tp::DOUBLE/np) + (tp::DOUBLE/ng))")} ELSE 0e0 END AS f1"""))
def span_metrics(spark, d):
    from ..operators.evaluation import span_prf

    return span_prf(_against_gold(spark, d)).select("sample_id", "candidate_id", "precision", "recall", "f1")


for _name, _key, _sql in [
    ("consistency", "concat_ws('~', st, en, txt, label, implicit)", f"CASE WHEN ng = 0 AND np = 0 THEN 1e0 WHEN tp = 0 THEN 0e0 ELSE {rnd(_F1)} END"),
    ("batch", "concat_ws('~', st, en, txt, label)", f"CASE WHEN ng = 0 AND np = 0 THEN 1e0 WHEN tp = 0 THEN 0e0 ELSE {rnd(_F1, 6)} END"),
    ("gold", "concat_ws('~', st, en, txt, label, implicit)", f"CASE WHEN ng = 0 AND np = 0 THEN 1e0 WHEN tp = 0 THEN 0e0 ELSE {rnd('2e0 * tp / (ng + np)', 6)} END"),
]:

    @query(f"span_f1_{_name}", _profile_sql(_key, f"{_sql} AS f1"))
    def _span_f1(spark, d, profile=_name):
        f1 = sp.span_f1(F.col("gold_spans"), F.col("spans"), profile)
        return _against_gold(spark, d).select("sample_id", "candidate_id", (f1 if profile == "consistency" else half_even(f1, 6)).alias("f1"))


# ---------------------------------------------------------------- consensus, routing, review

cte("psig", """
SELECT r.sample_id AS task_id, r.doc_id, r.run, r.candidate_id, 'pred-' || r.sample_id || '-' || r.run AS prediction_id, r.conf AS score,
       CASE substr(md5('risk|' || r.doc_id || '|' || r.run), 1, 1) WHEN '0' THEN 1e0 WHEN '1' THEN 0.25e0 ELSE 0e0 END AS risk, coalesce(s.sig, []) AS sig, coalesce(s.opt, '空标注') AS opt
FROM runs3 r LEFT JOIN (SELECT sample_id, run, list({a: st, b: en, c: txt, d: label} ORDER BY k) AS sig, string_agg(txt || ' / ' || label, '; ' ORDER BY k) AS opt FROM cspans GROUP BY 1, 2) s
ON r.sample_id = s.sample_id AND r.run = s.run
""", ["runs3", "cspans"])
cte("ptop", """
SELECT task_id, sig AS csig, n AS best_n FROM (SELECT task_id, sig, count(*) AS n, row_number() OVER (PARTITION BY task_id ORDER BY count(*) DESC, sig) AS r FROM psig GROUP BY 1, 2) WHERE r = 1
""", ["psig"])
cte("pf1", """
SELECT *, CASE WHEN na = 0 AND nb = 0 THEN 1e0 WHEN tp = 0 THEN 0e0 ELSE 2e0 * (tp::DOUBLE/na) * (tp::DOUBLE/nb) / ((tp::DOUBLE/na) + (tp::DOUBLE/nb)) END AS f1
FROM (SELECT p.*, t.csig, t.best_n, len(list_distinct(p.sig)) AS na, len(list_distinct(t.csig)) AS nb, len(list_intersect(p.sig, t.csig)) AS tp FROM psig p JOIN ptop t USING (task_id))
""", ["psig", "ptop"])
cte("cons", f"""
SELECT task_id, n AS candidate_count, {rnd('a * 0.5e0 + e * 0.2e0 + c * 0.2e0 + (1 - r) * 0.1e0')} AS score, {rnd('a')} AS agreement, {rnd('e')} AS exact_match_rate,
       {rnd('c')} AS avg_confidence, {rnd('r')} AS avg_rule_risk
FROM (SELECT task_id, count(*) AS n, sum(f1) / count(*) AS a, any_value(best_n)::DOUBLE / count(*) AS e,
             coalesce(sum(CAST(round(score * 10000) AS BIGINT))::DOUBLE / (count(score) * 1e4), 0.5e0) AS c, sum(risk) / count(*) AS r FROM pf1 GROUP BY 1)
""", ["pf1"])
cte("routed", """
SELECT c.*, CASE WHEN c.score >= 0.75e0 AND NOT audit THEN 'auto_accept' ELSE 'review' END AS route, audit AND c.score >= 0.75e0 AS is_audit, b.prediction_id AS best_prediction_id
FROM (SELECT *, ('0x' || substr(sha1('job-1:' || task_id), 1, 8))::BIGINT / 4294967295e0 < 0.05e0 AS audit FROM cons) c
JOIN (SELECT task_id, prediction_id FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY coalesce(score, 0) DESC, run) AS r FROM psig) WHERE r = 1) b ON c.task_id = b.task_id
""", ["cons", "psig"])


@query("consensus_scores", with_("cons") + "SELECT * FROM cons")
def consensus_scores(spark, d):
    return ag.consensus_scores(predictions(spark, d))


@query("consensus_candidates", with_("pf1") + f"""
SELECT task_id, prediction_id, {rnd('f1')} AS span_f1_to_consensus, score AS model_confidence, risk AS rule_risk, sig = csig AS is_consensus FROM pf1""")
def consensus_candidates(spark, d):
    c = ag.consensus_candidates(predictions(spark, d))
    return c.withColumn("is_consensus", F.col("agreement_group") == F.col("consensus_group")).drop("agreement_group", "consensus_group")


@query("audit_sample", """
SELECT doc_id, ('0x' || substr(sha1('job-1:' || printf('s%08d', doc_id)), 1, 8))::BIGINT / 4294967295e0 < 0.05e0 AS audited FROM documents""")
def audit_sample(spark, d):
    return table(spark, d, "documents").select("doc_id", rv.audit_sample(F.lit("job-1"), F.format_string("s%08d", "doc_id"), 0.05).alias("audited"))


@query("route_tasks", with_("routed") + """
SELECT task_id, score, agreement, exact_match_rate, avg_confidence, avg_rule_risk AS rule_risk, route, is_audit, CASE WHEN route = 'auto_accept' THEN 'auto' ELSE 'review' END AS source_pool,
       CASE WHEN route = 'auto_accept' THEN 'accept' END AS answer, best_prediction_id FROM routed""")
def route_tasks(spark, d):
    r = routed_tasks(spark, d)
    return r.withColumn("is_audit", F.col("route_reason") == rv.wording.ROUTE_REASON_AUDIT).drop("route_reason", "job_id")


@query("review_options", with_("routed", "psig") + """
SELECT 'review-' || p.task_id AS review_id, p.run AS position, chr(64 + p.run::INT) AS option_id, opt AS text FROM psig p JOIN routed r ON p.task_id = r.task_id AND r.route = 'review'
UNION ALL SELECT 'review-' || task_id, 6, 'manual', '以上都不对，我要手动修正' FROM routed WHERE route = 'review'""")
def review_options(spark, d):
    p, routed = routed_predictions(spark, d)
    return rv.review_options(rv.build_reviews(routed), p).withColumn("position", F.col("position").cast("long"))


@query("human_review_queue", with_("consist", "cmark") + f"""
SELECT c.sample_id, q.route, (CASE q.route WHEN 'low' THEN 100 WHEN 'medium' THEN 50 ELSE 10 END + {rnd('q.uncertainty_score * 10', 0)})::BIGINT AS priority,
       chr(64 + c.run::INT) AS option_id, c.candidate_id, md5(c.markup) AS markup_digest, c.conf AS model_confidence
FROM consist q JOIN cmark c ON q.sample_id = c.sample_id WHERE q.route IN ('medium', 'low')""")
def human_review_queue(spark, d):
    c = candidates(spark, d)
    q = rv.human_review_queue(c, ag.consistency_scores(c))
    return q.select("sample_id", "route", F.col("priority").cast("long").alias("priority"), "option_id", "candidate_id", F.md5("annotation_markup").alias("markup_digest"), "model_confidence")


@query("review_queue", with_("routed") + """
SELECT 'review-' || task_id AS review_id, score, agreement, avg_confidence FROM routed WHERE route = 'review' AND (score <= 0.75e0 OR is_audit)
ORDER BY score, agreement, avg_confidence, review_id LIMIT 200""")
def review_queue(spark, d):
    return rv.review_queue(reviews(spark, d), job_id="job-1").select("review_id", "score", "agreement", "avg_confidence")


@query("review_bundle", with_("routed", "psig") + """
SELECT 'review-' || p.task_id AS review_id, p.prediction_id, p.run, 'guide-' || d.lang AS guideline_id, length(d.text)::BIGINT AS text_chars,
       array_to_string(list_filter([printf('s%08d', g.a), CASE WHEN g.a * 2 + 1 <= g.mx THEN printf('s%08d', g.a * 2 + 1) END], lambda x: x IS NOT NULL), ',') AS gold_examples
FROM psig p JOIN routed r ON p.task_id = r.task_id AND r.route = 'review' JOIN documents d ON p.doc_id = d.doc_id
JOIN (SELECT lang, max(doc_id) AS a, (SELECT max(doc_id) FROM documents) AS mx FROM documents GROUP BY 1) g ON d.lang = g.lang""")
def review_bundle(spark, d):
    t = samples(spark, d)
    p, routed = routed_predictions(spark, d)
    by_lang = rv.build_reviews(routed).join(t.select(F.col("id").alias("task_id"), "lang"), "task_id").withColumn("job_id", F.concat(F.lit("job-"), F.col("lang"))).drop("lang")
    b = rv.review_bundle(by_lang, t, p, jobs(spark, d), guidelines(spark, d), gold_sets(spark, d))
    return b.select(
        "review_id", "prediction_id", "run", "guideline_id", F.length("text").cast("long").alias("text_chars"), F.array_join("gold_examples", ",").alias("gold_examples")
    )


cte("decided", """
SELECT 'review-' || r.task_id AS review_id, r.task_id, p.doc_id, r.route, l.toxic, l.quality, p.sig, o.prediction_id AS chosen, len(coalesce(o.sig, [])) AS chosen_n,
  CASE WHEN l.toxic = 1 THEN 'reject' WHEN p.doc_id % 13 = 0 THEN 'manual' WHEN l.quality = 1 THEN 'accept' ELSE 'skip' END AS kind, chr(65 + (p.doc_id % 3)::INT) AS letter,
  p.doc_id % 4 = 0 AS hard, p.doc_id % 6 = 0 AS promote, CASE WHEN p.doc_id % 5 = 0 THEN 'boundary' ELSE '' END AS err
FROM routed r JOIN psig p ON r.task_id = p.task_id AND p.run = 1 JOIN labels l ON p.doc_id = l.doc_id
LEFT JOIN psig o ON o.task_id = r.task_id AND o.run = p.doc_id % 3 + 1 WHERE r.route = 'review'
""", ["routed", "psig"])


@query("apply_decisions", with_("decided") + """
SELECT review_id, task_id, CASE kind WHEN 'skip' THEN 'ignored' WHEN 'reject' THEN 'rejected' ELSE 'accepted' END AS status,
  CASE kind WHEN 'skip' THEN 'skip' WHEN 'reject' THEN 'reject' WHEN 'manual' THEN 'manual' ELSE letter END AS answer,
  CASE kind WHEN 'reject' THEN 'reject' WHEN 'manual' THEN 'manual' WHEN 'accept' THEN chosen END AS selected_candidate_id, kind = 'manual' AS manually_edited, hard AS review_hard_example,
  CASE WHEN kind = 'reject' AND err = '' THEN 'all_candidates_wrong' ELSE err END AS error_type, kind IN ('manual', 'accept') AND promote AS promote_to_gold,
  CASE kind WHEN 'skip' THEN NULL WHEN 'reject' THEN 'reject' ELSE 'accept' END AS task_answer,
  CASE WHEN kind IN ('manual', 'accept') AND promote THEN 'gold_like' ELSE 'review' END AS task_source_pool,
  CASE kind WHEN 'manual' THEN 1 WHEN 'accept' THEN chosen_n ELSE -1 END::BIGINT AS new_span_count, CASE WHEN kind = 'accept' AND chosen IS NULL THEN 'invalid_option' END AS error FROM decided
UNION ALL
SELECT 'review-' || r.task_id, NULL, NULL, NULL, NULL, false, false, NULL, false, NULL, NULL, -2, 'unknown_review'
FROM routed r JOIN psig p ON r.task_id = p.task_id AND p.run = 1 JOIN labels l ON p.doc_id = l.doc_id WHERE r.route <> 'review'""")
def apply_decisions(spark, d):
    t = samples(spark, d).select("id", "spans").withColumn("source_pool", F.lit("review"))
    p, routed = routed_predictions(spark, d)
    a = rv.apply_decisions(rv.build_reviews(routed).withColumn("hard_example", F.lit(False)), decisions(spark, d), t, p)
    n = F.when(F.col("status") == "accepted", F.size("task_spans")).when(F.col("status").isNotNull(), -1).otherwise(-2).cast("long")
    return a.withColumn("new_span_count", n).fillna(False, ["manually_edited", "review_hard_example", "promote_to_gold"]).drop("task_spans", "review_note", "task_hard_example")
