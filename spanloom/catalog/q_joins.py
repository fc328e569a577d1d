"""Evaluation against gold, joins, set operations, sources and table maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import markup as mk
from ..functions.core import half_even, lines
from ..functions.spans import span_keys
from ..operators import agreement as ag
from ..operators import evaluation as ev
from ..operators import joins as jn
from ..operators import stats as st
from ..operators import validate as va
from ..sources import readers as rd
from ..sources import tables as tb
from ..sources import writers as wr
from . import q_stats  # noqa: F401  (shared expressions)
from .derived import annotated_tasks, candidates, decided_reviews, documents, gold_sets, hex1, joined, predictions, responses, routed_predictions, samples, table, versions
from .q_text import LE
from .registry import cte, query, rnd, strip, with_


@query("expand_gold_sets", """
SELECT gold_set_id, position, task_id, CASE WHEN t.doc_id IS NULL THEN 'failed' ELSE 'found' END AS route FROM (
  SELECT printf('gold-%08d', doc_id) AS gold_set_id, 0 AS position, printf('s%08d', doc_id) AS task_id FROM documents
  UNION ALL SELECT printf('gold-%08d', doc_id), 1, printf('s%08d', doc_id * 2 + 1) FROM documents) g LEFT JOIN documents t ON g.task_id = printf('s%08d', t.doc_id)""")
def expand_gold_sets(spark, d):
    return ev.expand_gold_sets(gold_sets(spark, d), samples(spark, d)).select("gold_set_id", "position", "task_id", F.coalesce("route", F.lit("found")).alias("route"))


cte("gcmp", f"""
SELECT *, {rnd('f1')} AS gold_score, CASE WHEN ng - tp = 0 AND np - tp = 0 THEN 'passed' WHEN f1 >= 0.5e0 THEN 'unstable' ELSE 'failed' END AS gold_route FROM (
  SELECT r.sample_id AS task_id, r.run, r.candidate_id, coalesce(g.n, 0) AS ng, coalesce(p.n, 0) AS np, coalesce(m.n, 0) AS tp,
         CASE WHEN coalesce(g.n, 0) = 0 AND coalesce(p.n, 0) = 0 THEN 1e0 WHEN coalesce(g.n, 0) = 0 OR coalesce(p.n, 0) = 0 THEN 0e0 ELSE 2e0 * coalesce(m.n, 0) / (coalesce(g.n, 0) + coalesce(p.n, 0)) END AS f1
  FROM runs3 r LEFT JOIN (SELECT id, count(*) AS n FROM gold GROUP BY 1) g ON r.sample_id = g.id
  LEFT JOIN (SELECT sample_id, run, count(*) AS n FROM cspans GROUP BY 1, 2) p ON r.sample_id = p.sample_id AND r.run = p.run
  LEFT JOIN (SELECT c.sample_id, c.run, count(*) AS n FROM cspans c JOIN gold g ON c.sample_id = g.id AND c.st = g.st AND c.en = g.en AND c.txt = g.txt AND c.label = g.label GROUP BY 1, 2) m
    ON r.sample_id = m.sample_id AND r.run = m.run)
""", ["runs3", "gold", "cspans"])
cte("gmiss", """
SELECT g.id AS task_id, r.run, 'missing' AS side, g.st, g.en, g.txt, g.label FROM gold g JOIN runs3 r ON g.id = r.sample_id
WHERE NOT EXISTS (SELECT 1 FROM cspans c WHERE c.sample_id = g.id AND c.run = r.run AND c.st = g.st AND c.label = g.label)
UNION ALL SELECT c.sample_id, c.run, 'extra', c.st, c.en, c.txt, c.label FROM cspans c WHERE NOT EXISTS (SELECT 1 FROM gold g WHERE g.id = c.sample_id AND g.st = c.st AND g.label = c.label)
""", ["gold", "runs3", "cspans"])


def _compared(spark, d, p=None):
    p = (predictions(spark, d) if p is None else p).select("task_id", F.concat(F.lit("c"), F.col("run").cast("string")).alias("candidate_id"), "run", "spans")
    return ev.gold_compare(samples(spark, d).select(F.col("id").alias("task_id"), "spans"), p)


@query("gold_compare", with_("gcmp") + "SELECT task_id, candidate_id, gold_score, gold_route, (ng - tp)::BIGINT AS missing_count, (np - tp)::BIGINT AS extra_count FROM gcmp")
def gold_compare(spark, d):
    c = _compared(spark, d)
    return c.select("task_id", "candidate_id", "gold_score", "gold_route", F.size("missing_spans").cast("long").alias("missing_count"), F.size("extra_spans").cast("long").alias("extra_count"))


@query("span_difference", with_("gold", "runs3", "cspans") + """
, g AS MATERIALIZED (SELECT id, st, en, txt, label, implicit FROM gold), r AS MATERIALIZED (SELECT sample_id, run FROM runs3), c AS MATERIALIZED (SELECT sample_id, run, st, en, txt, label, implicit FROM cspans)
SELECT x.id AS task_id, x.run, 'missing' AS side, x.st AS start, x.en AS "end", x.txt AS text, x.label FROM (SELECT g.*, r.run FROM g JOIN r ON g.id = r.sample_id) x
  ANTI JOIN c ON c.sample_id = x.id AND c.run = x.run AND c.st = x.st AND c.en = x.en AND c.txt = x.txt AND c.label = x.label AND c.implicit = x.implicit
UNION ALL SELECT c.sample_id, c.run, 'extra', c.st, c.en, c.txt, c.label FROM c
  ANTI JOIN g ON g.id = c.sample_id AND c.st = g.st AND c.en = g.en AND c.txt = g.txt AND c.label = g.label AND c.implicit = g.implicit""")
def span_difference(spark, d):
    c = _compared(spark, d)
    side = lambda name: F.transform(f"{name}_spans", lambda s: F.struct(F.lit(name).alias("side"), s["start"].cast("long").alias("start"), s["end"].cast("long").alias("end"), s["text"].alias("text"), s["label"].alias("label")))
    return c.select("task_id", "run", F.explode(F.concat(side("missing"), side("extra"))).alias("x")).select("task_id", "run", "x.*")


@query("concept_loss", with_("gcmp") + f"""
SELECT candidate_id, passed_count, failed_count, unstable_count, missing_count, extra_count, {rnd('ms')} AS mean_score,
       {rnd('failed_count * 10e0 + unstable_count * 5e0 + missing_count * 1.5e0 + extra_count * 1e0 + (1e0 - ms) * 2e0')} AS loss
FROM (SELECT candidate_id, count(*) FILTER (WHERE gold_route = 'passed') AS passed_count, count(*) FILTER (WHERE gold_route = 'failed') AS failed_count, count(*) FILTER (WHERE gold_route = 'unstable') AS unstable_count,
             sum(ng - tp)::BIGINT AS missing_count, sum(np - tp)::BIGINT AS extra_count, sum(CAST(round(gold_score * 10000) AS BIGINT))::DOUBLE / (count(*) * 1e4) AS ms FROM gcmp GROUP BY 1)""")
def concept_loss(spark, d):
    return ev.concept_loss(_compared(spark, d))


@query("length_penalty", f"""
SELECT event_id, {rnd('value')} AS raw_loss, ((props->>'$.k')::BIGINT * 20 - 600) AS length_delta, {rnd("greatest(0, (props->>'$.k')::BIGINT * 20 - 600) / 500e0")} AS length_penalty,
       {rnd(f"{rnd('value')} + {rnd(chr(34) + 'pen' + chr(34))}")} AS loss FROM (SELECT *, greatest(0, (props->>'$.k')::BIGINT * 20 - 600) / 500e0 AS pen FROM events)""")
def length_penalty(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("value").alias("loss"), (F.get_json_object("props", "$.k").cast("long") * 20).alias("n"))
    return ev.length_penalized(e, F.lit(600), F.col("n")).drop("n")


@query("local_rule_predict", with_("samples", "gold") + """
SELECT s.id, CASE WHEN coalesce(n, 0) > 0 THEN 1e0 ELSE 0.4e0 END AS score, CASE WHEN coalesce(n, 0) > 0 THEN 'passed' ELSE 'failed' END AS route, '{"span_count":' || coalesce(n, 0) || '}' AS raw_response
FROM samples s LEFT JOIN (SELECT id, count(*) AS n FROM gold GROUP BY 1) g ON s.id = g.id""")
def local_rule_predict(spark, d):
    return ev.local_rule_predict(samples(spark, d)).select("id", "score", "route", "raw_response")


@query("failure_summary", with_("gcmp", "gmiss") + """
, w AS (SELECT task_id, run, candidate_id, gold_route, row_number() OVER (PARTITION BY candidate_id ORDER BY task_id) AS r FROM gcmp WHERE gold_route <> 'passed'),
p AS (SELECT task_id, run, side, string_agg(txt, ', ' ORDER BY q) AS t FROM (SELECT *, row_number() OVER (PARTITION BY task_id, run, side ORDER BY st, en, txt, label) AS q FROM gmiss) WHERE q <= 3 GROUP BY 1, 2, 3)
SELECT w.candidate_id, string_agg(w.task_id || ': ' || CASE WHEN m.t IS NULL AND e.t IS NULL THEN '标注边界或标签不稳定' ELSE concat_ws('；', '漏标 ' || m.t, '多标 ' || e.t) END, chr(10) ORDER BY w.r) AS failure_summary
FROM w LEFT JOIN p m ON m.task_id = w.task_id AND m.run = w.run AND m.side = 'missing' LEFT JOIN p e ON e.task_id = w.task_id AND e.run = w.run AND e.side = 'extra' WHERE w.r <= 8 GROUP BY 1""")
def failure_summary(spark, d):
    return ev.failure_summary(_compared(spark, d), "candidate_id")


@query("failure_memory", with_("rfinal") + """
, v AS (SELECT 'failed ' || (props->>'$.k') AS note, ts FROM events WHERE event_type = 'signup' AND (props->>'$.k')::BIGINT % 10 = 0),
n AS (SELECT note, 0 AS s, max(ts) AS seen_at FROM v GROUP BY 1 UNION ALL SELECT note, 1, NULL FROM (SELECT coalesce(nullif(review_note, ''), nullif(error_type, '')) AS note FROM rfinal WHERE hard_example OR status = 'rejected') WHERE note IS NOT NULL AND note NOT IN (SELECT note FROM v) GROUP BY 1)
SELECT note, s AS source_rank FROM n ORDER BY s, seen_at DESC, note LIMIT 15""")
def failure_memory(spark, d):
    return ev.failure_memory(versions(spark, d), decided_reviews(spark, d), 15).select("note", "source_rank")


@query("infer_labels", with_("gold") + """
SELECT label, first_task, first_position FROM (SELECT label, id AS first_task, p AS first_position, row_number() OVER (PARTITION BY label ORDER BY id, p) AS r
FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY k) - 1 AS p FROM gold)) WHERE r = 1""")
def infer_labels(spark, d):
    return ev.infer_labels(samples(spark, d)).select("label", "first_task", F.col("first_position").cast("long").alias("first_position"))


@query("experiment_metrics", with_("tfinal", "rfinal", "runs3", "gold", "cspans") + f"""
, b AS (SELECT r.sample_id, r.run, coalesce(g.p, []) = coalesce(c.p, []) AS bm, coalesce(g.l, []) = coalesce(c.l, []) AS lm FROM runs3 r
  LEFT JOIN (SELECT id, list(DISTINCT {{a: st, b: en}} ORDER BY {{a: st, b: en}}) AS p, list(DISTINCT {{a: st, b: en, c: label}} ORDER BY {{a: st, b: en, c: label}}) AS l FROM gold GROUP BY 1) g ON r.sample_id = g.id
  LEFT JOIN (SELECT sample_id, run, list(DISTINCT {{a: st, b: en}} ORDER BY {{a: st, b: en}}) AS p, list(DISTINCT {{a: st, b: en, c: label}} ORDER BY {{a: st, b: en, c: label}}) AS l FROM cspans GROUP BY 1, 2) c ON r.sample_id = c.sample_id AND r.run = c.run)
SELECT (SELECT {rnd("avg(CASE WHEN route = 'review' THEN 1 ELSE 0 END)")} FROM tfinal) AS review_rate, (SELECT {rnd("avg(CASE WHEN status = 'accepted' AND NOT manually_edited THEN 1 ELSE 0 END)")} FROM rfinal) AS candidate_accept_rate,
 (SELECT {rnd("avg(CASE WHEN manually_edited THEN 1 ELSE 0 END)")} FROM rfinal) AS manual_rewrite_rate,
 (SELECT {rnd("avg(CASE WHEN is_audit AND status IN ('accepted', 'rejected') THEN CASE WHEN status = 'rejected' OR manually_edited THEN 1 ELSE 0 END END)")} FROM rfinal) AS high_confidence_audit_error_rate, (SELECT {rnd("avg(CASE WHEN bm THEN 1 ELSE 0 END)")} FROM b) AS boundary_exact_match, (SELECT {rnd("avg(CASE WHEN lm THEN 1 ELSE 0 END)")} FROM b) AS label_exact_match""")
def experiment_metrics(spark, d):
    work = routed_predictions(spark, d)
    return ev.experiment_metrics(decided_reviews(spark, d, work), annotated_tasks(spark, d, work), _compared(spark, d, work[0]))


@query("export_filters", with_("tfinal") + """
SELECT kind AS export_kind, task_id AS id FROM (SELECT task_id, unnest(list_filter([
  'all', CASE WHEN answer = 'accept' THEN 'confirmed' END, CASE WHEN route = 'auto_accept' THEN 'auto' END, CASE WHEN reviewed THEN 'reviewed' END,
  CASE WHEN hard_example THEN 'hard' END, CASE WHEN route = 'review' THEN 'low_confidence' END], lambda x: x IS NOT NULL)) AS kind FROM tfinal)
UNION ALL SELECT 'project', task_id FROM tfinal WHERE project_id = 'src3' AND coalesce(score, 0) BETWEEN 0.5e0 AND 0.9e0""")
def export_filters(spark, d):
    """What each export filter keeps, and one project with a range of scores."""
    from ..operators import validate as va

    t = annotated_tasks(spark, d)
    rows = va.export_kinds(t).select("export_kind", "id")
    return rows.unionByName(va.project_score_filter(t, "src3", 0.5, 0.9).select(F.lit("project").alias("export_kind"), "id"))


cte("vcount", "SELECT sample_id, candidate_id, count(*) AS n FROM vissues GROUP BY 1, 2", ["vissues"])


def _audit_rows(spark, d):
    from .q_validate import RULES, _verify_input

    v = _verify_input(spark, d)
    found = va.verify_responses(v, RULES).groupBy("sample_id", "candidate_id").agg(F.count(F.lit(1)).alias("issue_count"))
    gold = samples(spark, d).select(F.col("id").alias("sample_id"), mk.spans_to_markup(F.col("spans")).alias("gold_annotation"))
    rows = v.join(gold, "sample_id").join(found, ["sample_id", "candidate_id"], "left").withColumn("issue_count", F.coalesce("issue_count", F.lit(0)))
    return ev.audit_status(rows.withColumn("warning", F.when(F.col("text").isNull(), "unreadable")))


_AUDIT = with_("vresp", "vcount", "gold", "cspans") + """
, sg AS (SELECT id, list({a: txt, b: label, c: implicit} ORDER BY txt, label, implicit) AS s FROM gold GROUP BY 1),
sc AS (SELECT sample_id, run, list({a: txt, b: label, c: implicit} ORDER BY txt, label, implicit) AS s FROM cspans GROUP BY 1, 2),
au AS (SELECT v.sample_id, v.candidate_id, CASE WHEN v.unread AND sg.s IS NOT NULL OR NOT v.unread AND (h IN ('3', '4') AND NOT (h = '3' AND sg.s IS NULL) OR coalesce(sg.s, []) <> coalesce(sc.s, []) AND h <> '3') THEN 'conflict'
    WHEN v.unread OR coalesce(c.n, 0) > 0 THEN 'review' ELSE 'accepted' END AS status
FROM vresp v LEFT JOIN sg ON v.sample_id = sg.id LEFT JOIN sc ON v.sample_id = sc.sample_id AND v.run = sc.run LEFT JOIN vcount c ON v.sample_id = c.sample_id AND v.candidate_id = c.candidate_id)
"""


@query("audit_status", _AUDIT + "SELECT * FROM au")
def audit_status(spark, d):
    return _audit_rows(spark, d).select("sample_id", "candidate_id", "status")


@query("audit_manifest", _AUDIT + """
SELECT count(*) AS sample_count, count(*) FILTER (WHERE status = 'accepted') AS accepted_count, count(*) FILTER (WHERE status = 'review') AS review_count, count(*) FILTER (WHERE status = 'conflict') AS conflict_count FROM au""")
def audit_manifest(spark, d):
    return st.status_counts(_audit_rows(spark, d))


# ---------------------------------------------------------------- joins


@query("candidates_with_samples", with_("runs3") + """
SELECT r.sample_id, r.candidate_id, length(d.text)::BIGINT AS text_chars FROM runs3 r JOIN documents d ON r.doc_id = d.doc_id""")
def candidates_with_samples(spark, d):
    c = jn.candidates_with_samples(candidates(spark, d), samples(spark, d))
    return c.select("sample_id", "candidate_id", F.length("text").cast("long").alias("text_chars"))


@query("pending_tasks", "SELECT printf('s%08d', doc_id) AS task_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def pending_tasks(spark, d):
    done = table(spark, d, "labels").select(F.format_string("s%08d", "doc_id").alias("task_id"))
    return jn.pending_tasks(samples(spark, d).select(F.col("id").alias("task_id")), done)


@query("example_pool", with_("tfinal", "tspans") + """
, n AS (SELECT task_id, count(*) AS n FROM tspans GROUP BY 1),
g AS (SELECT DISTINCT id FROM (SELECT doc_id AS id FROM documents UNION ALL SELECT doc_id * 2 + 1 FROM documents)),
o AS (SELECT t.task_id, CASE WHEN route = 'auto_accept' AND score >= 0.8e0 THEN 'high_confidence' ELSE 'gold_like' END AS source_pool FROM tfinal t JOIN n USING (task_id)
      WHERE route = 'auto_accept' AND score >= 0.8e0 OR promote_to_gold OR source_pool = 'gold_like')
SELECT task_id AS id, source_pool FROM o UNION ALL SELECT t.task_id, 'gold' FROM tfinal t JOIN g ON t.doc_id = g.id WHERE t.task_id NOT IN (SELECT task_id FROM o)""")
def example_pool(spark, d):
    return jn.example_pool(gold_sets(spark, d), annotated_tasks(spark, d)).select("id", "source_pool")


@query("match_articles", """
WITH a AS (SELECT doc_id AS article_id, source || '-' || lang AS title, doc_id + 1 AS position FROM documents),
i AS (SELECT doc_id + 1 AS position, CASE WHEN doc_id % 2 = 0 THEN source || '-' || lang || ' ' ELSE 'unknown ' || doc_id END AS title FROM labels),
t AS (SELECT title, max(article_id) AS article_id FROM a GROUP BY 1)
SELECT i.position, CASE WHEN t.article_id IS NOT NULL THEN trim(i.title) ELSE coalesce(p.title, trim(i.title)) END AS title, coalesce(t.article_id, p.article_id) AS article_id,
  CASE WHEN t.article_id IS NOT NULL THEN 'title' WHEN p.article_id IS NOT NULL THEN 'position' ELSE 'none' END AS matched_by
FROM (SELECT l.doc_id + 1 AS position, CASE WHEN l.doc_id % 2 = 0 THEN d.source || '-' || d.lang || ' ' ELSE 'unknown ' || l.doc_id END AS title FROM labels l JOIN documents d ON l.doc_id = d.doc_id) i
LEFT JOIN t ON trim(i.title) = t.title LEFT JOIN a p ON i.position = p.position""")
def match_articles(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.concat_ws("-", "source", "lang").alias("title"))
    a = docs.select(F.col("doc_id").alias("article_id"), "title", (F.col("doc_id") + 1).alias("position"))
    i = table(spark, d, "labels").join(docs, "doc_id").select(
        (F.col("doc_id") + 1).alias("position"), F.when(F.col("doc_id") % 2 == 0, F.concat("title", F.lit(" "))).otherwise(F.concat(F.lit("unknown "), F.col("doc_id").cast("string"))).alias("title")
    )
    return jn.match_articles(i, a)


# ---------------------------------------------------------------- sources, sinks, tables


@query("jsonl_tasks", with_("alltok") + """
SELECT CASE WHEN d.doc_id % 3 = 0 THEN printf('jsonl-%05d', d.doc_id + 1) ELSE printf('s%08d', d.doc_id) END AS id, length(d.text)::BIGINT AS text_chars, 0 AS span_count, coalesce(t.n, 0) AS token_count, d.lang AS meta_lang, 'uploaded.jsonl' AS meta_source,
       'ok' AS error FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM alltok GROUP BY 1) t ON d.doc_id = t.doc_id WHERE d.doc_id % 10 NOT IN (7, 9)
UNION ALL SELECT CASE WHEN doc_id % 10 = 7 THEN printf('jsonl-%05d', doc_id + 1) ELSE printf('bad-%d', doc_id) END, 0, 0, 0, '', 'uploaded.jsonl', CASE WHEN doc_id % 10 = 7 THEN 'invalid_json' ELSE 'missing_text' END FROM documents WHERE doc_id % 10 IN (7, 9)""")
def jsonl_tasks(spark, d):
    doc = F.col("doc_id")
    meta = F.struct(F.col("lang"), F.lit("other").alias("source")).alias("meta")
    line = (
        F.when(doc % 10 == 7, F.concat(F.lit('{"id": "x", "text": '), F.lit('"cut off')))
        .when(doc % 10 == 9, F.to_json(F.struct(F.concat(F.lit("bad-"), doc.cast("string")).alias("id"))))
        .when(doc % 3 == 0, F.to_json(F.struct("text", meta)))
        .otherwise(F.to_json(F.struct(F.format_string("s%08d", doc).alias("id"), "text", meta)))
    )
    rows = documents(spark, d).select((doc + 1).alias("position"), line.alias("value"))
    t = rd.json_to_tasks(rows)
    zero = lambda c: F.when(F.col("error").isNull(), c).otherwise(F.lit(0)).cast("long")
    return t.select(
        F.when(F.col("error") == "invalid_json", F.col("id")).otherwise(F.col("id")).alias("id"), zero(F.length("text")).alias("text_chars"), F.size("spans").alias("span_count"), zero(F.size("tokens")).alias("token_count"),
        F.coalesce(F.col("meta")["lang"], F.lit("")).alias("meta_lang"), F.col("meta")["source"].alias("meta_source"), F.coalesce("error", F.lit("ok")).alias("error"),
    )


@query("csv_tasks", with_("alltok") + f"""
SELECT printf('csv-%05d', d.doc_id + 1) AS id, length({strip('d.text')})::BIGINT AS text_chars, coalesce(t.n, 0) AS token_count, d.lang AS meta_lang, d.source AS meta_origin, (d.doc_id + 1)::VARCHAR AS row_index
FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM alltok GROUP BY 1) t ON d.doc_id = t.doc_id WHERE {strip('d.text')} <> ''""")
def csv_tasks(spark, d):
    rows = documents(spark, d).select((F.col("doc_id") + 1).alias("position"), "text", "lang", F.col("source").alias("origin"))
    t = rd.rows_to_tasks(rows)
    m = F.col("meta")
    return t.select("id", F.length("text").cast("long").alias("text_chars"), F.size("tokens").cast("long").alias("token_count"), m["lang"].alias("meta_lang"), m["origin"].alias("meta_origin"), m["row_index"].alias("row_index"))


@query("gold_rows", with_("gold") + """
SELECT d.doc_id, CASE d.doc_id % 3 WHEN 0 THEN 'markup' WHEN 1 THEN 'spans' ELSE 'plain' END AS gold_format, CASE WHEN d.doc_id % 3 = 2 THEN 0 ELSE coalesce(n, 0) END AS span_count
FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM gold GROUP BY 1) g ON d.doc_id = g.doc_id""")
def gold_rows(spark, d):
    s, doc = samples(spark, d), F.col("doc_id")
    line = F.when(doc % 3 == 0, F.to_json(F.struct("text", mk.spans_to_markup(F.col("spans")).alias("annotation")))).when(doc % 3 == 1, F.to_json(F.struct("text", "spans"))).otherwise(F.to_json(F.struct("text")))
    return rd.gold_rows(s.select("doc_id", line.alias("value"))).select("doc_id", "gold_format", F.size("spans").cast("long").alias("span_count"))


@query("normalize_samples", with_("gold") + """
SELECT CASE WHEN d.doc_id % 4 = 3 THEN printf('sample-%04d', d.doc_id + 1) ELSE printf('s%08d', d.doc_id) END AS id, coalesce(n, 0) AS span_count, d.lang AS lang, 'ok' AS error
FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM gold GROUP BY 1) g ON d.doc_id = g.doc_id""")
def normalize_samples(spark, d):
    doc = F.col("doc_id")
    s = samples(spark, d).select("doc_id", F.format_string("s%08d", doc).alias("id"), "text", "spans", F.struct("lang").alias("meta"))
    begin = F.transform("spans", lambda x: F.struct(x["start"].alias("begin"), x["end"].alias("end"), x["text"].alias("text"), x["label"].alias("label"), x["implicit"].alias("implicit")))
    line = (
        F.when(doc % 4 == 0, F.to_json(F.struct("id", "text", begin.alias("spans"), "meta")))
        .when(doc % 4 == 1, F.to_json(F.struct("id", "text", mk.spans_to_markup(F.col("spans")).alias("gold_annotation"), F.col("meta").alias("metadata"))))
        .when(doc % 4 == 2, F.to_json(F.struct("id", "text", mk.annotation_doc(F.col("text"), F.col("spans")).alias("annotation"), "meta")))
        .otherwise(F.to_json(F.struct("text", "spans", "meta")))
    )
    out = rd.json_to_samples(s.select((doc + 1).alias("position"), line.alias("value")))
    return out.select("id", F.size("spans").cast("long").alias("span_count"), F.col("meta")["lang"].alias("lang"), F.coalesce("error", F.lit("ok")).alias("error"))


@query("normalize_candidates", with_("cmark") + """
SELECT sample_id, CASE WHEN run = 3 THEN 'run-' || doc_id ELSE candidate_id END AS candidate_id, n AS span_count, length(markup)::BIGINT AS markup_chars, conf AS model_confidence, 'ok' AS error FROM cmark""")
def normalize_candidates(spark, d):
    run = F.col("run")
    c = candidates(spark, d).select("*", mk.spans_to_markup(F.col("spans")).alias("m"))
    line = (
        F.when(run == 1, F.to_json(F.struct("sample_id", "candidate_id", "text", F.struct(F.lit("inline").alias("format"), F.col("m").alias("annotation_markup")).alias("runtime_annotation"), "model_confidence")))
        .when(run == 2, F.to_json(F.struct("sample_id", "candidate_id", F.col("text").alias("source_text"), F.col("m").alias("annotation"), "model_confidence")))
        .otherwise(F.to_json(F.struct("sample_id", F.concat(F.lit("run-"), F.col("doc_id").cast("string")).alias("run_id"), "text", "spans", "model_confidence")))
    )
    out = rd.json_to_candidates(c.select((F.col("doc_id") * 3 + run).alias("position"), line.alias("value")))
    return out.select("sample_id", "candidate_id", F.size("spans").cast("long").alias("span_count"), F.length("annotation_markup").cast("long").alias("markup_chars"), "model_confidence", F.coalesce("error", F.lit("ok")).alias("error"))


@query("seed_documents", f"""
SELECT CASE WHEN doc_id % 5 = 0 THEN printf('seed-%04d', doc_id + 1) ELSE 'd' || doc_id END AS doc_id, CASE WHEN doc_id % 5 = 0 THEN printf('seed-%04d', doc_id + 1) WHEN doc_id % 2 = 0 THEN 'd' || doc_id ELSE 'Title ' || doc_id END AS title,
  length({strip('text')})::BIGINT AS text_chars, CASE WHEN doc_id % 7 = 0 THEN 'unknown' ELSE lang END AS language, source AS domain, 'reference' AS source_type,
  CASE WHEN {strip('text')} = '' THEN 'empty_text' WHEN doc_id % 11 = 0 THEN 'bad_tags' ELSE 'ok' END AS error FROM documents""")
def seed_documents(spark, d):
    doc = F.col("doc_id")
    name = F.concat(F.lit("d"), doc.cast("string"))
    rows = documents(spark, d).select(
        (doc + 1).alias("position"), F.when(doc % 5 == 0, "  ").otherwise(F.concat(name, F.lit(" "))).alias("id"), F.when((doc % 2 == 0) | (doc % 5 == 0), " ").otherwise(F.concat(F.lit("Title "), doc.cast("string"))).alias("title"), "text",
        F.lit(None).cast("string").alias("source_type"), F.when(doc % 7 == 0, "").otherwise(F.col("lang")).alias("language"), F.col("source").alias("domain"),
        F.array(F.col("source"), F.when(doc % 11 == 0, " ").otherwise(F.col("lang"))).alias("tags"), F.create_map(F.lit("k"), F.lit("v")).alias("metadata"),
    )
    s = rd.seed_rows(rows)
    return s.select("doc_id", "title", F.length("text").cast("long").alias("text_chars"), "language", "domain", "source_type", F.coalesce("error", F.lit("ok")).alias("error"))


@query("task_records", with_("gold", "samples") + """
SELECT s.id, 'anno.task.v1' AS schema_version, coalesce(n, 0) AS span_count, coalesce(ids, '') AS first_ids, 'accept' AS answer FROM samples s
LEFT JOIN (SELECT id, count(*) AS n, array_to_string(list_slice(list('T' || p ORDER BY p), 1, 3), ',') AS ids FROM (SELECT id, row_number() OVER (PARTITION BY id ORDER BY k) AS p FROM gold) GROUP BY 1) g ON s.id = g.id""")
def task_records(spark, d):
    t = samples(spark, d).select("id", "text", "spans", F.lit("accept").alias("answer"), F.create_map(F.lit("lang"), F.col("lang")).alias("meta"))
    r = wr.task_records(t).select("id", F.from_json("value", "schema_version string, answer string, spans array<struct<id:string>>").alias("j"))
    ids = F.transform(F.slice("j.spans", 1, 3), lambda s: s["id"])
    return r.select("id", "j.schema_version", F.size("j.spans").cast("long").alias("span_count"), F.array_join(ids, ",").alias("first_ids"), "j.answer")


@query("labelstudio_items", with_("samples", "psig") + """
SELECT s.id, length(s.text)::BIGINT AS text_chars, count(p.prediction_id) AS prediction_count, string_agg(p.prediction_id, ',' ORDER BY p.run) AS prediction_ids FROM samples s LEFT JOIN psig p ON s.id = p.task_id GROUP BY 1, 2""")
def labelstudio_items(spark, d):
    r = wr.labelstudio_items(samples(spark, d), predictions(spark, d)).select("id", F.from_json("value", "data struct<text:string>, predictions array<struct<model_version:string,score:double,result:struct<id:string>>>").alias("j"))
    ids = F.transform("j.predictions", lambda x: x["result"]["id"])
    return r.select("id", F.length("j.data.text").cast("long").alias("text_chars"), F.size("j.predictions").cast("long").alias("prediction_count"), F.array_join(ids, ",").alias("prediction_ids"))


@query("upsert_tasks", """
SELECT user_id AS key, event_type, value, version FROM (SELECT user_id, event_type, value, event_id AS version, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1""")
def upsert_tasks(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("key"), "event_type", "value", F.col("event_id").alias("version"))
    return tb.upsert(e.where("version % 2 = 0"), e.where("version % 2 = 1"), ["key"], "version")


@query("list_reviews", with_("rfinal") + "SELECT review_id, status, score FROM rfinal WHERE status = 'pending' ORDER BY score DESC, review_id LIMIT 50")
def list_reviews(spark, d):
    return tb.lookup(decided_reviews(spark, d), {"status": "pending", "job_id": "job-1"}, [F.desc("score"), "review_id"], 50).select("review_id", "status", "score")


@query("merge_run_meta", """
SELECT run_id, status, CASE WHEN status IN ('completed', 'failed') THEN last_ts ELSE -1 END AS ended, 'v' || n AS attempt, 'kept' AS origin FROM (
  SELECT user_id AS run_id, CASE WHEN count(*) % 3 = 0 THEN 'completed' WHEN count(*) % 3 = 1 THEN 'failed' ELSE 'running' END AS status, epoch_us(max(ts)) AS last_ts, count(*) AS n FROM events GROUP BY 1)""")
def merge_run_meta(spark, d):
    e = table(spark, d, "events").groupBy(F.col("user_id").alias("run_id")).agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("at"))
    runs = e.select("run_id", F.lit("running").alias("status"), F.lit(None).cast("timestamp").alias("ended_at"), F.create_map(F.lit("origin"), F.lit("kept"), F.lit("attempt"), F.lit("v0")).alias("meta"))
    status = F.when(F.col("n") % 3 == 0, "completed").when(F.col("n") % 3 == 1, "failed").otherwise("running")
    patches = e.select("run_id", status.alias("status"), "at", F.create_map(F.lit("attempt"), F.concat(F.lit("v"), F.col("n").cast("string"))).alias("meta_patch"))
    m = tb.merge_run_patch(runs, patches)
    return m.select("run_id", "status", F.coalesce(F.unix_micros("ended_at"), F.lit(-1)).alias("ended"), F.col("meta")["attempt"].alias("attempt"), F.col("meta")["origin"].alias("origin"))


@query("migrate_annotations", with_("cplaced", "runs3") + """
SELECT r3.sample_id, r3.candidate_id, '3.1' AS version, coalesce(len(c.r.starts), 0)::BIGINT AS span_count, coalesce(len(list_filter(c.r.starts, lambda x: x < 0)), 0)::BIGINT AS unplaced
FROM runs3 r3 LEFT JOIN cplaced c ON c.sample_id = r3.sample_id AND c.candidate_id = r3.candidate_id""")
def migrate_annotations(spark, d):
    c = candidates(spark, d)
    old = c.select("sample_id", "candidate_id", "run", "text", F.when(F.col("run") == 2, F.to_json(mk.annotation_doc(F.col("text"), mk.markup_to_spans(F.col("text"), mk.spans_to_markup(F.col("spans")))))).otherwise(mk.spans_to_markup(F.col("spans"))).alias("annotation"))
    new = tb.migrate_annotations(old)
    return new.select(
        "sample_id", "candidate_id", "doc.version", F.size("doc.layers.spans").cast("long").alias("span_count"), F.size(F.filter("doc.layers.spans", lambda s: s["start"] < 0)).cast("long").alias("unplaced")
    )


@query("merge_catalogs", """
WITH e AS (SELECT 'c' || (doc_id % 300) AS name, doc_id AS n, 'existing' AS origin FROM documents WHERE lang = 'en'), i AS (SELECT 'c' || (doc_id % 400) AS name, doc_id AS n, 'imported' AS origin FROM documents WHERE lang <> 'en')
SELECT * FROM e UNION ALL SELECT * FROM i WHERE name NOT IN (SELECT name FROM e)""")
def merge_catalogs(spark, d):
    t = table(spark, d, "documents")
    pick = lambda df, m, o: df.select(F.concat(F.lit("c"), (F.col("doc_id") % m).cast("string")).alias("name"), F.col("doc_id").alias("n"), F.lit(o).alias("origin"))
    return tb.merge_catalogs(pick(t.where("lang = 'en'"), 300, "existing"), pick(t.where("lang <> 'en'"), 400, "imported"))


@query("import_preview", """
WITH e AS (SELECT 'c' || (doc_id % 300) AS name FROM documents WHERE lang = 'en'), i AS (SELECT 'c' || (doc_id % 400) AS name FROM documents WHERE lang <> 'en')
SELECT count(*) AS concept_count, count(*) FILTER (WHERE name IN (SELECT name FROM e)) AS duplicate_count, 0 AS auto_fix_count FROM i""")
def import_preview(spark, d):
    t = table(spark, d, "documents")
    pick = lambda df, m: df.select(F.concat(F.lit("c"), (F.col("doc_id") % m).cast("string")).alias("name"))
    return tb.import_preview(pick(t.where("lang = 'en'"), 300), pick(t.where("lang <> 'en'"), 400))


@query("catalog_issues", """
SELECT doc_id AS id, CASE doc_id % 9 WHEN 1 THEN 'prompt' WHEN 2 THEN 'is_default' WHEN 3 THEN 'examples' WHEN 8 THEN '' WHEN 4 THEN 'examples[0].explanation' WHEN 5 THEN 'examples[0].explanation' ELSE 'examples[0].annotation' END AS field,
  CASE doc_id % 9 WHEN 1 THEN 'missing_field' WHEN 4 THEN 'missing_field' WHEN 5 THEN 'blank' WHEN 6 THEN 'invalid_markup' WHEN 8 THEN 'invalid_json' ELSE 'wrong_type' END AS issue_code
FROM documents WHERE doc_id % 9 > 0""")
def catalog_issues(spark, d):
    """Catalogue entries made from the documents, most of them broken in one way, and what is found wrong with each."""
    from ..operators import validate as va

    way, text = F.col("doc_id") % 9, F.regexp_replace("text", r"[\[\]{}\\\\]", " ")
    note = F.when(way == 6, F.lit('"[old](Term)"')).when(way == 7, F.lit("7")).otherwise(F.to_json(F.struct(F.concat(F.lit("[term]{Term_A} "), text).alias("a"))).substr(F.lit(6), F.length(F.to_json(F.struct(F.concat(F.lit("[term]{Term_A} "), text).alias("a")))) - 6))
    explanation = F.when(way == 4, F.lit("")).when(way == 5, F.lit(', "explanation": "  "')).otherwise(F.lit(', "explanation": "why"'))
    examples = F.when(way == 3, F.lit('"none"')).otherwise(F.concat(F.lit('[{"text": "t", "annotation": '), note, explanation, F.lit("}]")))
    entry = F.concat(
        F.lit('{"name": "n", '), F.when(way == 1, F.lit("")).otherwise(F.lit('"prompt": "p", ')), F.lit('"category": "c", "is_default": '),
        F.when(way == 2, F.lit('"no"')).otherwise(F.lit("false")), F.lit(', "examples": '), examples, F.when(way == 8, F.lit("")).otherwise(F.lit("}")))
    return va.validate_catalog(documents(spark, d).select(F.col("doc_id").alias("id"), entry.alias("payload")))
