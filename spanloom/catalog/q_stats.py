"""Statistics queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.core import half_even
from ..operators import agreement as ag
from ..operators import joins as jn
from ..operators import reflection as rf
from ..operators import stats as st
from .derived import annotated_tasks, candidate_log, candidates, decided_reviews, jobs, predictions, samples, table, versions, work_tables
from .registry import cte, query, rnd, with_

cte("tfinal", """
SELECT r.task_id, d.doc_id, d.source AS project_id, r.route, r.score, r.agreement, r.avg_confidence, coalesce(x.kind, 'none') AS kind, coalesce(x.kind IN ('reject', 'manual', 'accept'), false) AS reviewed,
  coalesce(x.kind IN ('reject', 'manual', 'accept') AND x.hard, false) AS hard_example, coalesce(x.kind IN ('manual', 'accept') AND x.promote, false) AS promote_to_gold,
  CASE WHEN x.kind IN ('manual', 'accept') AND x.promote THEN 'gold_like' WHEN r.route = 'auto_accept' THEN 'auto' ELSE 'review' END AS source_pool,
  CASE WHEN x.kind = 'reject' THEN 'reject' WHEN x.kind IN ('manual', 'accept') OR r.route = 'auto_accept' THEN 'accept' END AS answer,
  CASE WHEN x.kind = 'accept' THEN d.doc_id % 3 + 1 WHEN x.kind = 'manual' THEN 0 ELSE CAST(right(r.best_prediction_id, 1) AS BIGINT) END AS span_run
FROM routed r JOIN samples d ON r.task_id = d.id LEFT JOIN decided x ON r.task_id = x.task_id
""", ["routed", "samples", "decided"])
cte("tspans", """
SELECT t.task_id, c.k, c.st, c.en, c.txt, c.label, c.implicit FROM tfinal t JOIN cspans c ON t.task_id = c.sample_id AND t.span_run = c.run
UNION ALL SELECT task_id, 1, -1, -1, 'by hand', 'Term_A', true FROM tfinal WHERE span_run = 0
""", ["tfinal", "cspans"])
cte("rfinal", """
SELECT 'review-' || r.task_id AS review_id, r.task_id, CASE x.kind WHEN 'skip' THEN 'ignored' WHEN 'reject' THEN 'rejected' WHEN 'accept' THEN 'accepted' WHEN 'manual' THEN 'accepted' ELSE 'pending' END AS status,
  coalesce(x.kind = 'manual', false) AS manually_edited, coalesce(x.hard, false) AS hard_example, coalesce(CASE WHEN x.kind = 'reject' AND x.err = '' THEN 'all_candidates_wrong' ELSE x.err END, '') AS error_type,
  CASE WHEN x.kind IS NULL THEN '' ELSE 'note ' || x.doc_id END AS review_note, r.is_audit, r.score
FROM routed r LEFT JOIN decided x ON r.task_id = x.task_id WHERE r.route = 'review'
""", ["routed", "decided"])


@query("dataset_stats", with_("tfinal", "tspans", "rfinal") + f"""
SELECT (SELECT count(*) FROM tfinal) AS task_count, (SELECT count(*) FROM runs3) AS prediction_count, (SELECT count(*) FROM rfinal) AS review_count,
  (SELECT count(*) FROM rfinal WHERE status = 'pending') AS pending_review_count, (SELECT count(*) FROM rfinal WHERE status = 'accepted') AS accepted_review_count,
  (SELECT count(DISTINCT lang) FROM documents) AS job_count, (SELECT {rnd("count(*) FILTER (WHERE route = 'auto_accept')::DOUBLE / count(*)")} FROM tfinal) AS auto_accept_rate,
  (SELECT {rnd("count(*) FILTER (WHERE route = 'review')::DOUBLE / count(*)")} FROM tfinal) AS review_rate, (SELECT count(*) FROM tfinal WHERE hard_example) AS hard_example_count,
  (SELECT count(*) FROM rfinal WHERE manually_edited) AS manual_edit_count, (SELECT count(*) FROM tfinal WHERE promote_to_gold) AS promoted_to_gold_count,
  (SELECT {rnd("sum(CAST(round(agreement * 10000) AS BIGINT))::DOUBLE / (count(*) * 1e4)")} FROM tfinal) AS avg_agreement, (SELECT count(*) FROM tfinal WHERE agreement < 0.6) AS low_consistency_count,
  (SELECT {rnd("sum(en - st)::DOUBLE / count(*)", 2)} FROM tspans WHERE st >= 0) AS avg_span_length""")
def dataset_stats(spark, d):
    return st.dataset_stats(*work_tables(spark, d))


@query("dataset_stats_by_project", with_("tfinal") + f"""
SELECT coalesce(project_id, 'all') AS project_id, coalesce(route, 'all') AS route, count(*) AS task_count, {rnd("count(*) FILTER (WHERE route0 = 'auto_accept')::DOUBLE / count(*)")} AS auto_accept_rate
FROM (SELECT *, route AS route0 FROM tfinal) GROUP BY ROLLUP (project_id, route)""")
def dataset_stats_by_project(spark, d):
    s = st.dataset_stats_by(annotated_tasks(spark, d).withColumn("route_", F.col("route")), "project_id", "route_")
    return s.select(F.coalesce("project_id", F.lit("all")).alias("project_id"), F.coalesce("route_", F.lit("all")).alias("route"), "task_count", "auto_accept_rate")


@query("label_distribution", with_("tspans") + "SELECT label, count(*) AS span_count FROM tspans GROUP BY 1")
def label_distribution(spark, d):
    return st.label_distribution(annotated_tasks(spark, d))


@query("route_distribution", with_("tfinal") + "SELECT route, count(*) AS task_count FROM tfinal GROUP BY 1")
def route_distribution(spark, d):
    return st.route_distribution(annotated_tasks(spark, d))


@query("document_label_counts", with_("gold") + "SELECT id, label, count(*) AS span_count, count(*) FILTER (WHERE implicit) AS implicit_count FROM gold GROUP BY 1, 2")
def document_label_counts(spark, d):
    c = st.document_label_counts(samples(spark, d))
    return c.select("id", "label", F.col("span_count").cast("long").alias("span_count"), F.col("implicit_count").cast("long").alias("implicit_count"))


@query("agreement_histogram", with_("tfinal") + "SELECT floor(agreement * 10) / 10e0 AS bucket, count(*) AS task_count FROM tfinal GROUP BY 1")
def agreement_histogram(spark, d):
    return st.agreement_histogram(annotated_tasks(spark, d))


def _token_sql(src: str) -> str:
    """Token statistics over ``src`` (key, doc_id) with spans in ``src_spans`` (key, st, en)."""
    return f"""
, tk AS (SELECT s.key, w.pos, w.tok, EXISTS (SELECT 1 FROM {src}_spans p WHERE p.key = s.key AND w.st < p.en AND w.en > p.st) AS ent FROM {src} s JOIN words w ON s.doc_id = w.doc_id),
rl AS (SELECT tok, ent, max(ent) OVER (PARTITION BY key ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM tk),
tstat AS (SELECT tok AS token, count(*) FILTER (WHERE ent) AS entity_count, count(*) FILTER (WHERE NOT ent AND near) AS context_count, count(*) FILTER (WHERE NOT ent AND NOT near) AS other_count, count(*) AS total FROM rl GROUP BY 1)
"""


_GOLD_SRC = """, src AS (SELECT id AS key, doc_id FROM samples), src_spans AS (SELECT id AS key, st, en FROM gold WHERE NOT implicit)"""
_POOL_SRC = """, src AS (SELECT DISTINCT g.id AS key, g.doc_id FROM gold g UNION ALL SELECT r.sample_id || ':' || r.candidate_id, r.doc_id FROM runs3 r JOIN consist q ON r.sample_id = q.sample_id AND q.route = 'high'),
src_spans AS (SELECT id AS key, st, en FROM gold WHERE NOT implicit UNION ALL SELECT c.sample_id || ':' || c.candidate_id, c.st, c.en FROM cspans c JOIN consist q ON c.sample_id = q.sample_id AND q.route = 'high' WHERE NOT c.implicit)"""
_REPORT = f"""SELECT token, entity_count, context_count, other_count, total, {rnd('entity_count::DOUBLE/total')} AS entity_probability,
{rnd('context_count::DOUBLE/total')} AS context_probability, {rnd('other_count::DOUBLE/total')} AS other_probability FROM tstat"""


@query("token_label_stats", with_("words", "gold", "samples") + _GOLD_SRC + _token_sql("src") + _REPORT)
def token_label_stats(spark, d):
    return st.token_stats_report(st.token_label_stats(samples(spark, d)))


@query("top_entity_tokens", with_("words", "gold", "samples") + _GOLD_SRC + _token_sql("src") + _REPORT + " ORDER BY entity_count DESC, entity_count::DOUBLE/total DESC, token DESC LIMIT 10")
def top_entity_tokens(spark, d):
    return st.token_stats_report(st.top_entity_tokens(st.token_label_stats(samples(spark, d))))


def _pool(spark, d):
    c = candidates(spark, d)
    s = samples(spark, d)
    return s, c, jn.stats_samples(s, c, ag.consistency_scores(c))


@query("stats_samples", with_("words", "gold", "samples", "consist", "cspans", "runs3") + _POOL_SRC + """
SELECT s.key AS id, count(p.key) AS span_count FROM src s LEFT JOIN src_spans p ON s.key = p.key GROUP BY 1""")
def stats_samples(spark, d):
    _, _, pool = _pool(spark, d)
    return pool.select("id", F.size(F.filter("spans", lambda s: ~s["implicit"])).cast("long").alias("span_count"))


@query("pool_token_stats", with_("words", "gold", "samples", "consist", "cspans", "runs3") + _POOL_SRC + _token_sql("src") + _REPORT)
def pool_token_stats(spark, d):
    _, _, pool = _pool(spark, d)
    return st.token_stats_report(st.token_label_stats(pool))


_REFLECT = """
, st2 AS (SELECT token, entity_count::DOUBLE/total AS ep, context_count::DOUBLE/total AS cp FROM tstat),
wt AS (SELECT w.doc_id, w.pos, w.tok, w.st, w.en, s.token IS NULL AS unseen, coalesce(s.ep >= 0.6e0, false) AS likely, coalesce(s.cp > s.ep, false) AS edge FROM words w LEFT JOIN st2 s ON w.tok = s.token),
cov AS (SELECT r.sample_id, r.candidate_id, t.*, EXISTS (SELECT 1 FROM cspans p WHERE p.sample_id = r.sample_id AND p.run = r.run AND NOT p.implicit AND t.st < p.en AND t.en > p.st) AS covered
        FROM runs3 r JOIN wt t ON r.doc_id = t.doc_id WHERE unseen OR likely),
ov AS (SELECT p.sample_id, p.candidate_id, p.k, t.tok, t.st, t.en, t.edge, row_number() OVER (PARTITION BY p.sample_id, p.candidate_id, p.k ORDER BY t.pos) AS a, row_number() OVER (PARTITION BY p.sample_id, p.candidate_id, p.k ORDER BY t.pos DESC) AS z
       FROM cspans p JOIN wt t ON p.doc_id = t.doc_id AND t.st < p.en AND t.en > p.st WHERE NOT p.implicit),
its AS (SELECT sample_id, candidate_id, CASE WHEN unseen THEN 'unseen_token' ELSE 'possible_false_negative' END AS item_type, tok, st, en, 0 AS a, pos AS b, 0 AS c FROM cov WHERE NOT covered
        UNION ALL SELECT sample_id, candidate_id, 'boundary_token', tok, st, en, 1, k, 0 FROM ov WHERE a = 1 AND edge UNION ALL SELECT sample_id, candidate_id, 'boundary_token', tok, st, en, 1, k, 1 FROM ov WHERE z = 1 AND edge),
refl AS (SELECT sample_id AS id, candidate_id, item_type, tok AS token, st AS start, en AS "end", r AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY sample_id, candidate_id ORDER BY a, b, c) AS r FROM (
    SELECT sample_id, candidate_id, item_type, tok, st, en, min(a) AS a, min(b) AS b, min(c) AS c FROM (
      SELECT *, row_number() OVER (PARTITION BY sample_id, candidate_id, item_type, tok, st, en ORDER BY a, b, c) AS q FROM its) WHERE q = 1 GROUP BY ALL)) WHERE r <= 8)
"""
def _reflect(spark, d):
    s, c, pool = _pool(spark, d)
    return rf.reflection_items(s, c, st.token_label_stats(pool))


@query("reflection_items", with_("words", "gold", "samples", "consist", "cspans", "runs3") + _POOL_SRC + _token_sql("src") + _REFLECT + "SELECT * FROM refl")
def reflection_items(spark, d):
    r = _reflect(spark, d)
    return r.select("id", "candidate_id", "item_type", "token", *[F.col(c).cast("long").alias(c) for c in ("start", "end", "rank")])


@query("reflection_item_counts", with_("words", "gold", "samples", "consist", "cspans", "runs3") + _POOL_SRC + _token_sql("src") + _REFLECT + "SELECT item_type, count(*) AS item_count FROM refl GROUP BY 1")
def reflection_item_counts(spark, d):
    return st.reflection_item_counts(_reflect(spark, d))


@query("route_counts", with_("consist") + """
SELECT r.route, count(q.sample_id) AS sample_count FROM (VALUES ('high'), ('medium'), ('low')) r(route) LEFT JOIN consist q ON r.route = q.route GROUP BY 1""")
def route_counts(spark, d):
    return st.route_counts(ag.consistency_scores(candidates(spark, d))).select("route", "sample_count")


@query("review_feedback_counts", with_("rfinal") + "SELECT error_type, count(*) AS review_count FROM rfinal WHERE error_type <> '' GROUP BY 1")
def review_feedback_counts(spark, d):
    return st.review_feedback_counts(decided_reviews(spark, d))


@query("version_report", """
SELECT event_id AS version, (props->>'$.k')::BIGINT AS pass_count, ((props->>'$.k')::BIGINT % 4) AS failed, ((props->>'$.k')::BIGINT % 3) AS unstable, user_id AS round_index FROM events WHERE event_type = 'signup'""")
def version_report(spark, d):
    v = st.version_report(versions(spark, d))
    return v.select("version", "pass_count", F.col("failed").cast("long").alias("failed"), F.col("unstable").cast("long").alias("unstable"), "round_index")


def _score_sql(raw: str) -> str:
    return f"least(5e0, greatest(1e0, {rnd(f'coalesce(TRY_CAST({raw} AS DOUBLE), 3e0)', 2)}))"


def _mean2(raw: str) -> str:
    return rnd(f"sum(CAST(round({_score_sql(raw)} * 100) AS BIGINT))::DOUBLE / (count(*) * 1e2)", 2)


@query("judge_averages", f"""
SELECT {_mean2("(n % 97 / 13e0)::VARCHAR")} AS brief_alignment, {_mean2("CASE WHEN n % 5 = 0 THEN 'n/a' ELSE (n % 6)::VARCHAR END")} AS style_fit,
       {_mean2("(quality * 4 + 1)::VARCHAR")} AS clarity, {_mean2("(5 - toxic * 7)::VARCHAR")} AS scientific_tone, {_mean2("CASE WHEN toxic = 1 THEN NULL ELSE '4.255' END")} AS usefulness
FROM (SELECT doc_id AS n, quality, toxic FROM labels)""")
def judge_averages(spark, d):
    n = F.col("doc_id")
    items = table(spark, d, "labels").select(
        (n % 97 / 13.0).cast("string").alias("brief_alignment"), F.when(n % 5 == 0, "n/a").otherwise((n % 6).cast("string")).alias("style_fit"),
        (F.col("quality") * 4 + 1).cast("string").alias("clarity"), (5 - F.col("toxic") * 7).cast("string").alias("scientific_tone"),
        F.when(F.col("toxic") == 1, F.lit(None).cast("string")).otherwise("4.255").alias("usefulness"),
    )
    return st.judge_averages(items)


@query("usage_summary", """
SELECT method, sum(a)::BIGINT AS llm_call_count, sum(CASE WHEN a = 1 THEN 0 ELSE n END)::BIGINT AS prompt_tokens, sum(CASE WHEN a = 1 THEN n ELSE 0 END)::BIGINT AS completion_tokens, sum(n)::BIGINT AS total_tokens
FROM (SELECT 'method-' || (conv_id % 3) AS method, CASE WHEN role = 'assistant' THEN 1 ELSE 0 END AS a, greatest(1, length(text) // 4) AS n FROM conversations) GROUP BY 1""")
def usage_summary(spark, d):
    c = table(spark, d, "conversations").withColumn("method", F.concat(F.lit("method-"), (F.col("conv_id") % 3).cast("string")))
    return st.usage_summary(st.conversation_calls(c), "method").drop("provider_elapsed_seconds")


cte("clog", """
SELECT event_id, user_id AS run_id, event_type AS method, date_trunc('day', ts) AS day, ts, k, value AS loss, 100 + k AS description_length, CASE WHEN k < 10 THEN 'memorization_guard_blocked' WHEN k < 20 THEN 'memorization_repair_failed' ELSE 'evaluated' END AS status,
       k % 3 AS repair_attempts, k >= 20 AS memorization_passed, k % 4 = 0 AS accepted, CASE WHEN k % 5 = 0 THEN value - 50 END AS mask_loss_delta, k % 2 = 0 AS critic, k % 3 = 0 AS controller, k % 5 = 0 AS mask
FROM (SELECT *, (props->>'$.k')::BIGINT AS k FROM events)
""")


@query("method_trace_summary", with_("clog") + """
SELECT method, count(*) FILTER (WHERE accepted) AS accepted_candidate_count, count(*) FILTER (WHERE critic) AS critic_trace_count, count(*) FILTER (WHERE controller) AS controller_trace_count,
       count(*) FILTER (WHERE mask) AS mask_trace_count, coalesce(max(mask_loss_delta), 0) AS max_mask_loss_delta, coalesce(min(mask_loss_delta), 0) AS min_mask_loss_delta FROM clog GROUP BY 1""")
def method_trace_summary(spark, d):
    return st.method_trace_summary(candidate_log(spark, d))


@query("repair_summary", with_("clog") + """
SELECT method, sum(repair_attempts)::BIGINT AS repair_attempt_count, count(*) FILTER (WHERE repair_attempts > 0 AND memorization_passed) AS repair_success_count,
       count(*) FILTER (WHERE status = 'memorization_repair_failed') AS repair_failed_count FROM clog GROUP BY 1""")
def repair_summary(spark, d):
    return st.repair_summary(candidate_log(spark, d), "method")


@query("home_metrics", f"""
SELECT (SELECT count(*) FROM documents) AS concept_count, (SELECT count(*) FROM documents WHERE lang <> 'en') AS custom_count, (SELECT count(*) FROM conversations) AS history_count,
       (SELECT {rnd('sum(length(text))::DOUBLE / count(*)')} FROM conversations) AS avg_length""")
def home_metrics(spark, d):
    c = table(spark, d, "documents").select((F.col("lang") == "en").alias("is_default"))
    m = st.home_metrics(c, table(spark, d, "conversations").select(F.col("text").alias("annotation")))
    return m.withColumn("avg_length", half_even(F.col("avg_length"), 4))


@query("run_manifest", with_("consist", "runs3", "samples") + """
SELECT 'run-1' AS run_name, 'sample_count' AS metric, count(*) AS value FROM samples UNION ALL SELECT 'run-1', 'candidate_count', count(*) FROM runs3
UNION ALL SELECT 'run-1', 'review_task_count', count(*) FROM consist WHERE route IN ('medium', 'low')""")
def run_manifest(spark, d):
    c = candidates(spark, d)
    q = ag.consistency_scores(c).where(F.col("route").isin("medium", "low"))
    return st.run_manifest("run-1", sample=samples(spark, d), candidate=c, review_task=q)
