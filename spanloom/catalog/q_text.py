"""Text, token, markup and response queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import markup as mk
from ..functions import responses as rs
from ..functions import text as tx
from ..functions.core import SPACE_CLASS, lines
from .derived import candidates, documents, responses, samples, table
from .registry import TRIM, WS, collapse, cte, query, rnd, shorten, strip, with_

LE = r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"
SENT = r"[^。！？!?；;\.\n]+[。！？!?；;\.]?"

cte("sents", f"""
SELECT doc_id, unnest(s) AS sentence, generate_subscripts(s, 1)::BIGINT AS sentence_index FROM (
  SELECT doc_id, flatten(list_transform(
    list_filter(list_transform(regexp_split_to_array(text, '{LE}'), lambda x: {strip('x')}), lambda x: x <> ''),
    lambda l: CASE WHEN len(regexp_extract_all(l, '{SENT}')) = 0 THEN [l]
      ELSE list_filter(list_transform(regexp_extract_all(l, '{SENT}'), lambda m: {strip('m')}), lambda m: m <> '') END)) AS s
  FROM documents)
""")


@query("split_sentences", with_("sents") + "SELECT doc_id, sentence_index, sentence FROM sents")
def split_sentences(spark, d):
    df = documents(spark, d).select("doc_id", F.posexplode(tx.split_sentences(F.col("text"))).alias("pos", "sentence"))
    return df.select("doc_id", (F.col("pos") + 1).cast("long").alias("sentence_index"), "sentence")


cte("alltok", rf"""
SELECT doc_id, piece AS tok, en - length(piece) AS st, en, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS pos
FROM placed WHERE NOT regexp_matches(piece, '^[{WS}]$')
""", ["placed"])


@query("tokenize", with_("alltok") + """
SELECT doc_id, count(*) AS token_count, sum(st)::BIGINT AS start_sum, max(en)::BIGINT AS last_end,
       md5(string_agg(tok || '@' || st, ' ' ORDER BY pos)) AS digest FROM alltok GROUP BY doc_id""")
def tokenize(spark, d):
    # Texts with a token are found by a pattern: a filter on the token array would tokenise twice.
    t = documents(spark, d).where(F.col("text").rlike(f"[^{SPACE_CLASS}]")).select("doc_id", tx.tokenize(F.col("text")).alias("t"))
    return t.select(
        "doc_id", F.size("t").cast("long").alias("token_count"),
        F.aggregate("t", F.lit(0).cast("long"), lambda a, x: a + x["start"]).alias("start_sum"),
        F.element_at("t", -1)["end"].cast("long").alias("last_end"),
        F.md5(F.array_join(F.transform("t", lambda x: F.concat(x["text"], F.lit("@"), x["start"].cast("string"))), " ")).alias("digest"),
    )


@query("tokenize_words", with_("words") + """
SELECT doc_id, count(*) AS token_count, count(DISTINCT tok) AS distinct_count,
       md5(string_agg(tok || '@' || st, ' ' ORDER BY pos)) AS digest FROM words GROUP BY doc_id""")
def tokenize_words(spark, d):
    t = documents(spark, d).where(F.col("text").rlike("[A-Za-z0-9_一-鿿]")).select("doc_id", "text", tx.tokenize_words(F.col("text")).alias("t"))
    return t.select(
        "doc_id", F.size("t").cast("long").alias("token_count"), F.size(tx.word_set(F.col("text"))).cast("long").alias("distinct_count"),
        F.md5(F.array_join(F.transform("t", lambda x: F.concat(x["text"], F.lit("@"), x["start"].cast("string"))), " ")).alias("digest"),
    )


@query("text_tasks", with_("sents", "alltok") + f"""
SELECT printf('txt-%d-%05d', doc_id, sentence_index) AS id, doc_id, sentence_index, sentence AS text, 'txt' AS source_format,
       len(list_filter(regexp_extract_all(sentence, '[A-Za-z0-9_]+|[^A-Za-z0-9_]'), lambda p: NOT regexp_matches(p, '^[{WS}]$')))::BIGINT AS token_count
FROM sents""")
def text_tasks(spark, d):
    from ..sources.readers import text_to_tasks

    t = text_to_tasks(documents(spark, d).select("doc_id", "text"), "doc_id", prefix=F.concat(F.lit("txt-"), F.col("doc_id").cast("string")))
    return t.select("id", "doc_id", F.col("sentence_index").cast("long").alias("sentence_index"), "text", "source_format", F.size("tokens").cast("long").alias("token_count"))


@query("shorten_text", f"SELECT doc_id, {shorten('text', 160)} AS summary, length({shorten('text', 2000)})::BIGINT AS long_length FROM documents")
def shorten_text(spark, d):
    t = F.col("text")
    return documents(spark, d).select(
        "doc_id", tx.shorten(t, 160).alias("summary"), F.length(tx.shorten(t, 2000)).cast("long").alias("long_length")
    )


@query("key_sentences", rf"""
SELECT doc_id, unnest(k) AS sentence, generate_subscripts(k, 1)::BIGINT AS pos FROM (
  SELECT doc_id, list_transform(list_slice(list_filter(list_transform(
    string_split(regexp_replace({strip('text')}, '([。！？!?；;])[{WS}]*', '\1' || chr(30), 'g'), chr(30)), lambda x: {collapse('x')}), lambda x: x <> ''), 1, 3),
    lambda x: {shorten('x', 140)}) AS k FROM documents)""")
def key_sentences(spark, d):
    df = documents(spark, d).select("doc_id", F.posexplode(tx.key_sentences(F.col("text"))).alias("pos", "sentence"))
    return df.select("doc_id", "sentence", (F.col("pos") + 1).cast("long").alias("pos"))


@query("dedupe_keep_order", f"""
SELECT doc_id, len(u)::BIGINT AS kept, md5(array_to_string(u, chr(10))) AS digest, len(w)::BIGINT AS words_kept, md5(array_to_string(w, ' ')) AS words_digest FROM (
  SELECT doc_id, list_slice(list_filter(l, lambda x, i: list_position(l, x) = i), 1, 20) AS u, list_filter(r, lambda x, i: list_position(f, lower(x)) = i) AS w
  FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '{LE}'), lambda x: {strip('x')}), lambda x: x <> '') AS l,
               regexp_extract_all(text, '[A-Za-z]+') AS r, list_transform(regexp_extract_all(text, '[A-Za-z]+'), lambda x: lower(x)) AS f FROM documents))""")
def dedupe_keep_order(spark, d):
    raw = F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))
    df = documents(spark, d).select(
        "doc_id", tx.dedupe_keep_order(lines(F.col("text")), 20).alias("u"), tx.dedupe_keep_order(raw, ignore_case=True).alias("w"),
    )
    return df.select(
        "doc_id", F.size("u").cast("long").alias("kept"), F.md5(F.array_join("u", "\n")).alias("digest"),
        F.size("w").cast("long").alias("words_kept"), F.md5(F.array_join("w", " ")).alias("words_digest"),
    )


@query("length_units", f"""
SELECT doc_id, CASE WHEN c = '' THEN 0 WHEN lower(lang) LIKE 'en%' THEN len(string_split(c, ' ')) ELSE length(c) END::BIGINT AS units,
       greatest(1, length(text) // 4)::BIGINT AS token_estimate FROM (SELECT *, {collapse('text')} AS c FROM documents)""")
def length_units(spark, d):
    t = F.col("text")
    return documents(spark, d).select(
        "doc_id", tx.length_units(t, F.col("lang")).cast("long").alias("units"), tx.token_estimate(t).cast("long").alias("token_estimate")
    )


PREFIXES = ["the", "of", "labels", "que", "die", "der"]


@query("strip_protocol_lines", rf"""
SELECT doc_id, md5(t) AS digest, length(t)::BIGINT AS kept_chars FROM (SELECT doc_id, {strip(r"regexp_replace(array_to_string(list_filter(ls, lambda x: x = '' OR NOT regexp_matches(ltrim(lower(x), '-*0123456789. ' || chr(9)), '^(the|of|labels|que|die|der)')), chr(10)), '\n{3,}', chr(10) || chr(10), 'g')")} AS t
FROM (SELECT doc_id, list_transform(regexp_split_to_array(text, '{LE}'), lambda x: CASE WHEN {strip('x')} = '' THEN '' ELSE rtrim(x, {TRIM}) END) AS ls FROM documents))""")
def strip_protocol_lines(spark, d):
    t = tx.strip_protocol_lines(F.col("text"), PREFIXES)
    return documents(spark, d).select("doc_id", t.alias("t")).select("doc_id", F.md5("t").alias("digest"), F.length("t").cast("long").alias("kept_chars"))


HEADINGS = [("the", "boundary_rules"), ("in", "negative_rules"), ("of", "output_format"), ("que", "label_schema"), ("die", "boundary_rules")]

cte("segs", f"""
SELECT doc_id, kind, index, {strip("string_agg(rtrim(line, " + TRIM + "), chr(10) ORDER BY i)")} AS text FROM (
  SELECT *, dense_rank() OVER (PARTITION BY doc_id ORDER BY g) AS index FROM (
    SELECT *, coalesce(last_value(k IGNORE NULLS) OVER w, 'task_definition') AS kind,
           sum(CASE WHEN k IS NOT NULL OR b THEN 1 ELSE 0 END) OVER w AS g
    FROM (SELECT *, {strip('line')} = '' AS b, CASE WHEN starts_with(h, 'the') THEN 'boundary_rules' WHEN starts_with(h, 'in') THEN 'negative_rules'
            WHEN starts_with(h, 'of') THEN 'output_format' WHEN starts_with(h, 'que') THEN 'label_schema' WHEN starts_with(h, 'die') THEN 'boundary_rules' END AS k
          FROM (SELECT *, lower(rtrim({strip('line')}, ':：')) AS h
                FROM (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, regexp_split_to_array(text, '{LE}') AS l FROM documents))))
    WINDOW w AS (PARTITION BY doc_id ORDER BY i)) WHERE NOT b) GROUP BY doc_id, kind, index
""")


@query("segment_text", with_("segs") + """
SELECT doc_id, printf('seg-%02d-%s', index, kind) AS segment_id, kind, text, index, kind NOT IN ('output_format', 'label_schema') AS mutable FROM segs""")
def segment_text(spark, d):
    df = documents(spark, d).select("doc_id", F.explode(tx.segment_text(F.col("text"), HEADINGS)).alias("s"))
    return df.select(
        "doc_id", F.col("s.id").alias("segment_id"), "s.kind", "s.text", F.col("s.index").cast("long").alias("index"), "s.mutable"
    )


cte("cmark", """
SELECT r.sample_id, r.doc_id, r.run, r.candidate_id, r.text, r.conf,
       coalesce(m.markup, '') AS markup, coalesce(m.n, 0) AS n
FROM runs3 r LEFT JOIN (
  SELECT sample_id, run, count(*) AS n, string_agg('[' || CASE WHEN implicit THEN '!' ELSE '' END || txt || ']{' || label || '}', ' ' ORDER BY k) AS markup
  FROM cspans GROUP BY 1, 2) m ON r.sample_id = m.sample_id AND r.run = m.run
""", ["runs3", "cspans"])


@query("spans_to_markup", with_("cmark") + "SELECT sample_id, candidate_id, length(markup)::BIGINT AS chars, md5(markup) AS digest FROM cmark")
def spans_to_markup(spark, d):
    m = candidates(spark, d).select("sample_id", "candidate_id", mk.spans_to_markup(F.col("spans")).alias("m"))
    return m.select("sample_id", "candidate_id", F.length("m").cast("long").alias("chars"), F.md5("m").alias("digest"))


@query("parse_markup", with_("cspans") + """
SELECT sample_id, candidate_id, label, implicit, count(*) AS n, md5(string_agg(txt, '|' ORDER BY k)) AS digest FROM cspans GROUP BY ALL""")
def parse_markup(spark, d):
    m = candidates(spark, d).select("sample_id", "candidate_id", mk.parse_markup(mk.spans_to_markup(F.col("spans"))).alias("m"))
    kinds = F.array_distinct(F.transform("m", lambda t: F.struct(t["label"].alias("label"), t["implicit"].alias("implicit"))))
    e = m.select("sample_id", "candidate_id", "m", F.explode(kinds).alias("k"))
    own = F.filter("m", lambda t: (t["label"] == F.col("k.label")) & (t["implicit"] == F.col("k.implicit")))
    return e.select(
        "sample_id", "candidate_id", "k.label", "k.implicit", F.size(own).cast("long").alias("n"),
        F.md5(F.array_join(F.transform(own, lambda t: t["text"]), "|")).alias("digest"),
    )


cte("cplaced", """
SELECT sample_id, run, candidate_id, list_reduce(toks, lambda a, x: list_transform([CASE WHEN x.implicit THEN 0 ELSE instr(substr(text, a.pos + 1), x.txt) END],
         lambda f: {pos: CASE WHEN f > 0 THEN a.pos + f - 1 + length(x.txt) ELSE a.pos END,
                    starts: list_append(a.starts, CASE WHEN f > 0 THEN a.pos + f - 1 ELSE -1 END)})[1], {pos: 0::BIGINT, starts: []::BIGINT[]}) AS r
FROM (SELECT c.sample_id, c.run, c.candidate_id, any_value(t.text) AS text, list({txt: txt, implicit: implicit} ORDER BY k) AS toks
      FROM cspans c JOIN documents t ON c.doc_id = t.doc_id GROUP BY 1, 2, 3)
""", ["cspans"])


@query("markup_to_spans", with_("cplaced", "runs3") + """
SELECT r3.sample_id, r3.candidate_id, coalesce(len(c.r.starts), 0)::BIGINT AS span_count, coalesce(len(list_filter(c.r.starts, lambda x: x < 0)), 0)::BIGINT AS unplaced,
       md5(coalesce(array_to_string(c.r.starts, ','), '')) AS digest FROM runs3 r3 LEFT JOIN cplaced c ON c.sample_id = r3.sample_id AND c.candidate_id = r3.candidate_id""")
def markup_to_spans(spark, d):
    c = candidates(spark, d)
    m = c.select("sample_id", "candidate_id", mk.markup_to_spans(F.col("text"), mk.spans_to_markup(F.col("spans"))).alias("s"))
    starts = F.transform("s", lambda x: x["start"].cast("string"))
    return m.select(
        "sample_id", "candidate_id", F.size("s").cast("long").alias("span_count"),
        F.size(F.filter("s", lambda x: x["start"] < 0)).cast("long").alias("unplaced"), F.md5(F.array_join(starts, ",")).alias("digest"),
    )


@query("relocate_spans", with_("cspans", "runs3") + """
SELECT r3.sample_id, r3.candidate_id, count(pos0) AS span_count, coalesce(sum(moved), 0)::BIGINT AS moved, coalesce(sum(pos0), 0)::BIGINT AS start_sum FROM runs3 r3 LEFT JOIN (
  SELECT sample_id, candidate_id, CASE WHEN implicit THEN -1 ELSE instr(text, txt) - 1 END AS pos0, CASE WHEN NOT implicit AND instr(text, txt) - 1 <> st THEN 1 ELSE 0 END AS moved
  FROM cspans JOIN documents USING (doc_id)) x ON x.sample_id = r3.sample_id AND x.candidate_id = r3.candidate_id GROUP BY 1, 2""")
def relocate_spans(spark, d):
    c = candidates(spark, d)
    m = c.select("sample_id", "candidate_id", "spans", mk.relocate_spans(F.col("spans"), F.col("text")).alias("s"))
    total = lambda f: F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + f(x))
    moved = F.aggregate(F.zip_with("spans", "s", lambda a, b: F.when(a["start"] != b["start"], 1).otherwise(0)), F.lit(0).cast("long"), lambda a, x: a + x)
    return m.select(
        "sample_id", "candidate_id", F.size("s").cast("long").alias("span_count"), moved.alias("moved"), total(lambda x: x["start"]).alias("start_sum"),
    )


cte("resp", """
SELECT *, CASE h WHEN '0' THEN substr(plain, 1, length(plain) - 5) WHEN '1' THEN '```json' || chr(10) || plain || chr(10) || '```'
         WHEN '2' THEN to_json({text: text, annotation: mark2, model_confidence: conf})::VARCHAR
         WHEN '4' THEN full_doc WHEN '5' THEN full_doc ELSE plain END AS raw
FROM (SELECT c.*, mark2, to_json({text: text, annotation: mark2, explanation: CASE WHEN h = '3' THEN ' ' ELSE 'long words' END, confidence: conf})::VARCHAR AS plain,
        to_json({text: text, annotation: {version: '3.1', text: CASE WHEN h = '5' THEN text || '!' ELSE text END, layers: {spans: coalesce(sp, [])}},
                 explanation: 'long words', model_confidence: conf})::VARCHAR AS full_doc
      FROM (SELECT *, substr(md5('resp|' || doc_id || '|' || run), 1, 1) AS h,
                   CASE substr(md5('resp|' || doc_id || '|' || run), 1, 1) WHEN '7' THEN '' WHEN '6' THEN '[old](Term)' ELSE markup END AS mark2 FROM cmark) c
      LEFT JOIN (SELECT sample_id, run, list({id: 'T' || k, 'start': st, 'end': en, text: txt, label: label, implicit: implicit} ORDER BY k) AS sp FROM cspans GROUP BY 1, 2) s
      ON c.sample_id = s.sample_id AND c.run = s.run)
""", ["cmark", "cspans"])
cte("parsed", rf"""
SELECT *, CASE WHEN j IS NULL THEN 'invalid_json' WHEN NOT (json_exists(j, '$.text') AND json_exists(j, '$.annotation') AND json_exists(j, '$.explanation')) THEN 'missing_fields'
    WHEN json_type(j, '$.explanation') <> 'VARCHAR' OR {strip("(j->>'$.explanation')")} = '' THEN 'blank_explanation'
    WHEN json_type(j, '$.annotation') = 'OBJECT' THEN CASE WHEN (j->>'$.annotation.text') <> (j->>'$.text') THEN 'doc_text_mismatch' END
    WHEN {strip("(j->>'$.annotation')")} = '' THEN NULL
    WHEN regexp_matches(j->>'$.annotation', '\[[^\[\]]+\][{WS}]*\([^)]+\)') THEN 'markup_old_format'
    WHEN NOT regexp_matches(j->>'$.annotation', '\[([^\[\]]+)\]\{{([^{{}}]+)\}}') THEN 'markup_no_span' END AS warning,
  coalesce(TRY_CAST(coalesce(j->>'$.confidence', j->>'$.model_confidence') AS DOUBLE), 0.7e0) AS confidence
FROM (SELECT sample_id, candidate_id, run, h, text, n, conf, markup, raw, CASE WHEN json_valid(cleaned) THEN cleaned::JSON END AS j
      FROM (SELECT *, {strip("regexp_replace(regexp_replace(regexp_replace(" + strip("raw") + ", '^```json', ''), '^```', ''), '```$', '')")} AS cleaned FROM resp))
""", ["resp"])


@query("parse_responses", with_("parsed") + f"""
SELECT sample_id, candidate_id, coalesce(warning, 'ok') AS warning, {rnd('least(1e0, greatest(0e0, confidence))')} AS confidence,
       CASE WHEN warning IS NOT NULL THEN 0 WHEN h = '7' THEN 0 ELSE n END::BIGINT AS span_count FROM parsed""")
def parse_responses(spark, d):
    r = responses(spark, d).select("sample_id", "candidate_id", rs.parse_response(F.col("raw")).alias("p"), rs.confidence_of(F.col("raw"), 0.7).alias("confidence"))
    return r.select(
        "sample_id", "candidate_id", F.coalesce("p.warning", F.lit("ok")).alias("warning"), "confidence", F.size("p.spans").cast("long").alias("span_count"),
    )


@query("annotation_documents", with_("cmark", "cspans") + """
SELECT c.sample_id, c.candidate_id, '3.1' AS version, length(c.text)::BIGINT AS text_chars, coalesce(s.n, 0) AS span_count, coalesce(s.labels, '') AS labels
FROM cmark c LEFT JOIN (SELECT sample_id, run, count(*) AS n, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM cspans GROUP BY 1, 2) s
ON c.sample_id = s.sample_id AND c.run = s.run""")
def annotation_documents(spark, d):
    c = candidates(spark, d)
    doc = mk.annotation_doc(F.col("text"), mk.markup_to_spans(F.col("text"), mk.spans_to_markup(F.col("spans"))))
    c = c.select("sample_id", "candidate_id", doc.alias("doc"))
    labels = F.array_sort(F.array_distinct(F.transform("doc.layers.spans", lambda s: s["label"])))
    return c.select(
        "sample_id", "candidate_id", "doc.version", F.length("doc.text").cast("long").alias("text_chars"),
        F.size("doc.layers.spans").cast("long").alias("span_count"), F.array_join(labels, ",").alias("labels"),
    )


@query("redact_payloads", """
SELECT event_id, '[redacted]' AS prompt, event_type AS stage, CASE WHEN length(note) <= 500 THEN note ELSE substr(note, 1, 500) || '...' END AS note,
       least(k, 100)::BIGINT AS item_count, '[redacted]' AS inner_text, k AS inner_k, user_id::VARCHAR AS tag_user, '[redacted]' AS tag_text
FROM (SELECT *, repeat(event_type, 10 + k) AS note FROM (SELECT *, (props->>'$.k')::BIGINT AS k FROM events))""")
def redact_payloads(spark, d):
    e = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    payload = F.struct(
        F.col("props").alias("Prompt"), F.col("event_type").alias("stage"), F.expr("repeat(event_type, int(10 + k))").alias("note"),
        F.sequence(F.lit(1), F.greatest("k", F.lit(1)).cast("int")).alias("items"),
        F.struct(F.col("props").alias("text"), F.col("k").alias("k")).alias("inner"),
        F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.lit("TEXT"), F.col("props")).alias("tags"),
    )
    e = e.select("event_id", "k", payload.alias("payload"))
    safe = rs.redact(F.col("payload"), e.schema["payload"].dataType)
    s = e.select("event_id", "k", safe.alias("p"))
    return s.select(
        "event_id", F.col("p.Prompt").alias("prompt"), "p.stage", "p.note",
        F.when(F.col("k") > 0, F.size("p.items")).otherwise(0).cast("long").alias("item_count"), F.col("p.inner.text").alias("inner_text"),
        F.col("p.inner.k").alias("inner_k"), F.col("p.tags")["user"].alias("tag_user"), F.col("p.tags")["TEXT"].alias("tag_text"),
    )


@query("sanitize_descriptions", rf"""
SELECT doc_id, md5(CASE WHEN c = '' OR regexp_matches(c, 'gold-[0-9]') OR (dropped AND NOT shaped) THEN 'fallback' ELSE c END) AS digest FROM (
 SELECT doc_id, c, dropped, (contains(c, '概念描述：')) AND (contains(c, 'Labels:') OR contains(c, 'Boundary')) AS shaped FROM (
  SELECT doc_id, dropped, {strip(r"regexp_replace(array_to_string(list_transform(kept, lambda x: CASE WHEN " + strip('x') + r" = '' THEN '' ELSE rtrim(x, " + TRIM + r") END), chr(10)), '\n{3,}', chr(10) || chr(10), 'g')")} AS c
  FROM (SELECT doc_id, len(list_filter(ls, lambda x: regexp_matches(x, '\bgold-[0-9]+\b'))) > 0 AS dropped,
               list_filter(ls, lambda x: NOT regexp_matches(x, '\bgold-[0-9]+\b')) AS kept
        FROM (SELECT doc_id, regexp_split_to_array(txt, '{LE}') AS ls FROM (
          SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '概念描述：' || text || chr(10) || 'see gold-' || doc_id || chr(10) || 'Labels: A'
                              WHEN doc_id % 5 = 1 THEN text || chr(10) || 'gold-7 failed' ELSE text END AS txt FROM documents)))))""")
def sanitize_descriptions(spark, d):
    i, t = F.col("doc_id"), F.col("text")
    shown = (
        F.when(i % 5 == 0, F.concat(F.lit("概念描述："), t, F.lit("\nsee gold-"), i.cast("string"), F.lit("\nLabels: A")))
        .when(i % 5 == 1, F.concat(t, F.lit("\ngold-7 failed")))
        .otherwise(t)
    )
    return documents(spark, d).select("doc_id", F.md5(tx.sanitize_description(shown, F.lit("fallback"))).alias("digest"))
