"""Validation, filters and judging."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import responses as rs
from ..functions.spans import rule_risk
from ..functions.markup import spans_to_markup
from ..operators import validate as va
from ..plans.corpus import generate
from ..session import checkpoint_dir
from .derived import candidates, dirty_tasks, documents, hex1, joined, responses, samples, table
from .registry import TRIM, WS, cte, query, rnd, strip, with_

cte("dirty", """
SELECT id AS task_id, doc_id, k, CASE WHEN h = '4' THEN 'T1' WHEN k = 1000000000 THEN 'TI' ELSE 'T' || k END AS span_id,
       CASE WHEN h = '0' AND NOT implicit THEN st + 1 ELSE st END AS st,
       CASE WHEN h = '0' AND NOT implicit THEN en + 1 WHEN h = '2' AND NOT implicit THEN n + 5 ELSE en END AS en,
       CASE WHEN h = '5' THEN '' ELSE txt END AS txt, CASE WHEN h = '1' THEN ' ' ELSE label END AS label, h = '3' OR implicit AS implicit, n, text
FROM (SELECT g.*, length(d.text) AS n, d.text, substr(md5('dirty|' || g.doc_id || '|' || g.st), 1, 1) AS h FROM gold g JOIN documents d ON g.doc_id = d.doc_id)
""", ["gold"])
cte("span_issues", """
SELECT task_id, span_id, issue_code FROM (
  SELECT task_id, span_id, CASE WHEN trim(txt) = '' THEN 'empty_text' WHEN trim(label) = '' THEN 'empty_label'
    WHEN implicit AND (st <> -1 OR en <> -1) THEN 'implicit_offsets' WHEN implicit THEN NULL WHEN st < 0 OR en <= st THEN 'bad_offsets'
    WHEN en > n THEN 'out_of_range' WHEN substr(text, st + 1, en - st) <> txt THEN 'text_mismatch' END AS issue_code FROM dirty) WHERE issue_code IS NOT NULL
UNION ALL SELECT task_id, span_id, 'duplicate_id' FROM dirty GROUP BY 1, 2 HAVING count(*) > 1
""", ["dirty"])


@query("validate_spans", with_("span_issues") + "SELECT * FROM span_issues")
def validate_spans(spark, d):
    return va.validate_spans(dirty_tasks(spark, d))


@query("span_issue_counts", with_("span_issues") + "SELECT issue_code, count(*) AS n, count(DISTINCT task_id) AS task_count FROM span_issues GROUP BY 1")
def span_issue_counts(spark, d):
    i = va.validate_spans(dirty_tasks(spark, d)).groupBy("task_id", "issue_code").agg(F.count(F.lit(1)).alias("c"))
    return i.groupBy("issue_code").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("task_count"))


@query("validate_refs", with_("dirty") + """
, ids AS (SELECT task_id, doc_id, list(DISTINCT span_id) AS ids, substr(md5('refs|' || doc_id), 1, 1) AS h FROM dirty GROUP BY 1, 2),
allh AS (SELECT printf('s%08d', doc_id) AS task_id, substr(md5('refs|' || doc_id), 1, 1) AS h FROM documents)
SELECT task_id, 'R3' AS ref, 'relation_without_reference' AS issue_code FROM ids WHERE h > 'c'
UNION ALL SELECT task_id, 'T1', 'unknown_head' FROM ids WHERE NOT list_contains(ids, 'T1')
UNION ALL SELECT task_id, x, 'unknown_child' FROM (SELECT task_id, ids, unnest(list_distinct(['T2', CASE WHEN h < '3' THEN 'T99999' ELSE 'T1' END, 'T1'])) AS x FROM ids) WHERE NOT list_contains(ids, x)
UNION ALL SELECT task_id, 'Z', 'unknown_accept' FROM allh WHERE h = '7'""")
def validate_refs(spark, d):
    return va.validate_refs(dirty_tasks(spark, d))


cte("badmark", """
SELECT sample_id, candidate_id, h, CASE h WHEN '0' THEN '  ' WHEN '1' THEN '[old](Term) ' || markup WHEN '2' THEN 'no span here' WHEN '3' THEN '[a]{ } ' || markup
  WHEN '4' THEN markup || ' [! ]{L}' WHEN '5' THEN '[ ]{L}' ELSE markup END AS m
FROM (SELECT *, substr(md5('mark|' || doc_id || '|' || run), 1, 1) AS h FROM cmark)
""", ["cmark"])


@query("validate_markup", with_("badmark") + """
SELECT sample_id, candidate_id, CASE WHEN trim(m) = '' THEN 'blank' WHEN h = '1' THEN 'old_format' WHEN h = '2' THEN 'no_span' WHEN h = '3' THEN 'empty_label'
  WHEN h = '4' THEN 'empty_implied' WHEN h = '5' THEN 'empty_text' ELSE 'ok' END AS issue_code FROM badmark""")
def validate_markup(spark, d):
    h = hex1(joined("mark|", F.col("doc_id"), "|", F.col("run")))
    c = candidates(spark, d).select("sample_id", "candidate_id", h.alias("h"), spans_to_markup(F.col("spans")).alias("markup"))
    m = F.col("markup")
    m = (
        F.when(F.col("h") == "0", F.lit("  ")).when(F.col("h") == "1", F.concat(F.lit("[old](Term) "), m)).when(F.col("h") == "2", F.lit("no span here"))
        .when(F.col("h") == "3", F.concat(F.lit("[a]{ } "), m)).when(F.col("h") == "4", F.concat(m, F.lit(" [! ]{L}"))).when(F.col("h") == "5", F.lit("[ ]{L}")).otherwise(m)
    )
    return va.validate_markup(c.select("sample_id", "candidate_id", m.alias("markup"))).select(
        "sample_id", "candidate_id", F.coalesce("issue_code", F.lit("ok")).alias("issue_code")
    )


@query("validate_documents", """
SELECT doc_id, CASE h WHEN '0' THEN 'invalid_json' WHEN '1' THEN 'not_an_object' WHEN '2' THEN 'missing_field' WHEN '3' THEN 'layers_not_an_object'
  WHEN '4' THEN 'spans_not_a_list' WHEN '5' THEN 'span_missing_field' ELSE 'ok' END AS issue_code
FROM (SELECT doc_id, substr(md5('doc|' || doc_id), 1, 1) AS h FROM documents)""")
def validate_documents(spark, d):
    body = F.to_json(F.struct("text")).substr(F.lit(2), F.length(F.to_json(F.struct("text"))) - 2)
    h = F.col("h")
    doc = (
        F.when(h == "0", F.concat(F.lit('{"version":"3.1",'), body))
        .when(h == "1", F.concat(F.lit("["), F.lit("1"), F.lit("]")))
        .when(h == "2", F.concat(F.lit("{"), body, F.lit(',"layers":{"spans":[]}}')))
        .when(h == "3", F.concat(F.lit('{"version":"3.1",'), body, F.lit(',"layers":[]}')))
        .when(h == "4", F.concat(F.lit('{"version":"3.1",'), body, F.lit(',"layers":{"spans":{}}}')))
        .when(h == "5", F.concat(F.lit('{"version":"3.1",'), body, F.lit(',"layers":{"spans":[{"id":"T1","start":0}]}}')))
        .otherwise(F.concat(F.lit('{"version":"3.1",'), body, F.lit(',"layers":{"spans":[{"id":"T1","start":0,"end":1,"text":"x","label":"L","implicit":false}]}}')))
    )
    rows = documents(spark, d).select("doc_id", hex1(joined("doc|", F.col("doc_id"))).alias("h"), "text").select("doc_id", doc.alias("doc"))
    return va.validate_documents(rows).select("doc_id", F.coalesce("issue_code", F.lit("ok")).alias("issue_code"))


RULES = [("a_with_x", ["Term_A", "Term_X"]), ("b_c_implied", ["Term_B", "Term_C", "Term_I"])]

cte("vresp", """
SELECT c.*, h = '0' OR h = '2' AS unread, CASE WHEN h = '1' THEN text || ' ' ELSE text END AS got_text,
       CASE WHEN h = '3' THEN '[old](x)' WHEN h = '4' THEN markup || ' [zzzz qqqq]{Term_A}' ELSE markup END AS m2, CASE WHEN h = '5' THEN ' ' ELSE 'why' END AS expl
FROM (SELECT *, substr(md5('ver|' || doc_id || '|' || run), 1, 1) AS h FROM cmark) c
""", ["cmark"])
cte("vissues", """
SELECT sample_id, candidate_id, 'invalid_json' AS code, 'error' AS severity, '' AS detail FROM vresp WHERE unread
UNION ALL SELECT sample_id, candidate_id, 'text_mismatch', 'warning', '' FROM vresp WHERE NOT unread AND h = '1'
UNION ALL SELECT sample_id, candidate_id, 'invalid_annotation', 'error', CASE WHEN h = '3' THEN 'old_format' ELSE 'blank' END FROM vresp WHERE NOT unread AND (h = '3' OR m2 = '')
UNION ALL SELECT sample_id, candidate_id, 'span_not_found', 'error', 'zzzz qqqq' FROM vresp WHERE NOT unread AND h = '4'
UNION ALL SELECT sample_id, candidate_id, 'missing_explanation', 'error', '' FROM vresp WHERE NOT unread AND h = '5' AND m2 <> ''
UNION ALL SELECT v.sample_id, v.candidate_id, 'logic_conflict', 'error', r.name FROM vresp v
  JOIN (SELECT sample_id, run, list(DISTINCT label) AS labs FROM cspans GROUP BY 1, 2) l ON v.sample_id = l.sample_id AND v.run = l.run,
  (VALUES ('a_with_x', ['Term_A', 'Term_X']), ('b_c_implied', ['Term_B', 'Term_C', 'Term_I'])) r(name, labels)
  WHERE NOT unread AND h <> '3' AND m2 <> '' AND list_has_all(CASE WHEN h = '4' THEN list_append(labs, 'Term_A') ELSE labs END, r.labels)
""", ["vresp", "cspans"])


def _verify_input(spark, d):
    h = F.col("h")
    c = candidates(spark, d).select(
        "sample_id", "candidate_id", "doc_id", "run", F.col("text").alias("sample_text"), hex1(joined("ver|", F.col("doc_id"), "|", F.col("run"))).alias("h"),
        spans_to_markup(F.col("spans")).alias("markup"),
    )
    unread = h.isin("0", "2")
    null = F.lit(None).cast("string")
    return c.select(
        "sample_id", "candidate_id", "sample_text",
        F.when(unread, null).when(h == "1", F.concat("sample_text", F.lit(" "))).otherwise(F.col("sample_text")).alias("text"),
        F.when(unread, null).when(h == "3", "[old](x)").when(h == "4", F.concat("markup", F.lit(" [zzzz qqqq]{Term_A}"))).otherwise(F.col("markup")).alias("annotation"),
        F.when(unread, null).when(h == "5", " ").otherwise("why").alias("explanation"),
    )


@query("verify_responses", with_("vissues") + "SELECT * FROM vissues")
def verify_responses(spark, d):
    return va.verify_responses(_verify_input(spark, d), RULES).select("sample_id", "candidate_id", "code", "severity", "detail")


cte("goldissues", """
SELECT task_id, (row_number() OVER (PARTITION BY task_id ORDER BY k) - 1)::BIGINT AS span_index, txt, label, implicit, text FROM dirty
""", ["dirty"])
cte("goldissues2", """
SELECT task_id, span_index, 'empty_span' AS issue_code FROM goldissues WHERE txt = ''
UNION ALL SELECT task_id, span_index, 'unknown_label' FROM goldissues WHERE label <> '' AND label NOT IN ('Term_A', 'Term_B', 'Term_I')
UNION ALL SELECT task_id, span_index, 'span_not_in_text' FROM goldissues WHERE txt <> '' AND NOT implicit AND NOT contains(text, txt)
UNION ALL SELECT printf('s%08d', doc_id), -1, 'empty_text' FROM documents WHERE trim(text) = ''
""", ["goldissues"])
LABELS = ["Term_A", "Term_B", "Term_I"]


@query("gold_format_issues", with_("goldissues2") + "SELECT * FROM goldissues2")
def gold_format_issues(spark, d):
    return va.gold_format_issues(dirty_tasks(spark, d), LABELS).withColumn("span_index", F.col("span_index").cast("long"))


@query("gold_format_check", with_("goldissues2") + """
SELECT (SELECT count(*) FROM documents) AS checked_gold_count, count(*) AS issue_count, CASE WHEN count(*) = 0 THEN 'passed' ELSE 'failed' END AS status FROM goldissues2""")
def gold_format_check(spark, d):
    return va.gold_format_check(dirty_tasks(spark, d), LABELS)


@query("rule_risk", with_("dirty") + f"""
SELECT s.task_id, {rnd("CASE WHEN s.task_id LIKE '%7' THEN 1e0 ELSE least(1e0, coalesce(bad, 0)::DOUBLE / greatest(coalesce(n, 0), 1)) END")} AS risk
FROM (SELECT printf('s%08d', doc_id) AS task_id FROM documents) s
LEFT JOIN (SELECT task_id, count(*) AS n, count(*) FILTER (WHERE NOT implicit AND (st < 0 OR en > n OR substr(text, st + 1, en - st) <> txt)) AS bad FROM dirty GROUP BY 1) b ON s.task_id = b.task_id""")
def rule_risk_query(spark, d):
    from ..functions.core import half_even

    t = dirty_tasks(spark, d)
    warning = F.when(F.col("id").endswith("7"), "warned")
    return t.select(F.col("id").alias("task_id"), half_even(rule_risk(F.col("spans"), F.col("text"), warning), 4).alias("risk"))


BANNED = ["ciónmi", "thouon", "secret"]
TERMS = ["tion", "ment", "ung", "ción"]


def _items(docs):
    """Documents as generated items, to be judged."""
    doc = F.col("doc_id")
    ids = F.when(doc % 11 == 0, F.array().cast("array<string>")).when(doc % 7 == 0, F.array(doc.cast("string"), (doc + 1).cast("string"))).otherwise(F.array(doc.cast("string")))
    return docs.select(
        "doc_id", F.regexp_extract("text", r"^[^\n]*", 0).alias("prompt"), F.col("text").alias("response"), F.col("lang").alias("language"),
        F.col("source").alias("domain"), ids.alias("source_chunk_ids"), F.array(doc.cast("string")).alias("allowed_ids"), F.array(*[F.lit(t) for t in TERMS]).alias("term_pack"),
    )


_JUDGED = rf"""
 i AS (SELECT d.doc_id, {strip("coalesce(regexp_extract(text, '^[^\\n]*', 0), '')")} AS p, {strip('text')} AS r, lang, source,
  CASE WHEN doc_id % 11 = 0 THEN []::BIGINT[] WHEN doc_id % 7 = 0 THEN [doc_id, doc_id + 1] ELSE [doc_id] END AS ids FROM documents d),
judged AS (SELECT i.doc_id, array_to_string(list_filter([
  CASE WHEN p = '' THEN 'missing_prompt' WHEN length(p) < 20 THEN 'short_prompt' END, CASE WHEN r = '' THEN 'missing_response' WHEN length(r) < 400 THEN 'short_response' END,
  CASE WHEN lang <> 'en' THEN 'language_mismatch' END, CASE WHEN source <> 'src3' THEN 'domain_mismatch' END,
  CASE WHEN len(ids) = 0 THEN 'missing_lineage' WHEN len(ids) > 1 THEN 'invalid_source' END,
  CASE WHEN contains(p || chr(10) || r, 'ciónmi') THEN 'banned_term:ciónmi' WHEN contains(p || chr(10) || r, 'thouon') THEN 'banned_term:thouon' WHEN contains(p || chr(10) || r, 'secret') THEN 'banned_term:secret' END,
  CASE WHEN NOT (contains(p || chr(10) || r, 'tion') OR contains(p || chr(10) || r, 'ment') OR contains(p || chr(10) || r, 'ung') OR contains(p || chr(10) || r, 'ción')) THEN 'weak_grounding' END
  ], lambda x: x IS NOT NULL), ',') AS issues FROM i)
"""


@query("judge_items", "WITH" + _JUDGED + "SELECT j.doc_id, j.issues, coalesce(q.quality, -1) AS quality FROM judged j LEFT JOIN labels q ON j.doc_id = q.doc_id")
def judge_items(spark, d):
    judged = va.judge_items(_items(documents(spark, d)), "en", "src3", BANNED, min_prompt=20, min_response=400)
    return judged.join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left").select(
        "doc_id", F.array_join("issues", ",").alias("issues"), F.coalesce("quality", F.lit(-1)).alias("quality")
    )


@query("resumed_run", "WITH" + _JUDGED + """
SELECT printf('task-%08d', doc_id) AS task_id, CASE WHEN doc_id % 13 = 0 THEN 0 WHEN doc_id % 4 < 2 THEN 1 ELSE 2 END AS attempt, CASE WHEN doc_id % 13 = 0 THEN 0 ELSE 1 END AS item_count,
  CASE WHEN doc_id % 13 = 0 THEN '' WHEN issues = '' THEN 'accepted' ELSE 'review' END AS status, CASE WHEN doc_id % 13 = 0 THEN '' ELSE issues END AS issues FROM judged""")
def resumed_run(spark, d):
    """A corpus run that is stopped after two of its four parts and started again: no task is done twice, none is left out, and one without items counts too."""
    docs = documents(spark, d)
    tasks = docs.select(F.format_string("task-%08d", "doc_id").alias("task_id"), F.col("doc_id").alias("task_index"))

    def attempt(number):
        def work(todo, so_far):
            some = _items(docs.where("doc_id % 13 <> 0")).withColumn("task_id", F.format_string("task-%08d", "doc_id")).join(todo.select("task_id"), "task_id", "left_semi")
            judged = va.judge_items(some, "en", "src3", BANNED, min_prompt=20, min_response=400)
            return judged.select("task_id", "status", F.array_join("issues", ",").alias("issues"), F.lit(number).alias("attempt"))

        return work

    target = f"{checkpoint_dir(spark)}/corpus-{uuid.uuid4().hex}"
    generate(tasks, attempt(1), target, stop_after=2)
    one = F.get("items", F.lit(0))
    text = lambda c: F.coalesce(one[c], F.lit("")).alias(c)
    return generate(tasks, attempt(2), target).select("task_id", F.coalesce(one["attempt"], F.lit(0)).alias("attempt"), F.size("items").alias("item_count"), text("status"), text("issues"))
