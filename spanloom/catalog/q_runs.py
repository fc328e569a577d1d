"""Run analytics, event streams in batch form, reports."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import wording
from ..functions import text as tx
from ..functions.core import half_even
from ..operators import runs as ru
from ..plans import reports as rep
from ..session import checkpoint_dir, kept
from ..sources.generations import read_state
from ..streaming import alerts as sa
from ..streaming import jobs as sj
from .derived import candidate_log, documents, table, versions, work_tables
from .q_text import HEADINGS
from .registry import cte, query, rnd, with_

cte("rev", """
SELECT event_id, ts, user_id AS run_id, CASE event_type WHEN 'purchase' THEN 'call_succeeded' WHEN 'error' THEN 'call_failed' WHEN 'signup' THEN 'candidate_evaluated' WHEN 'view' THEN 'progress' ELSE 'call_started' END AS event_type,
       value AS loss, (props->>'$.k')::BIGINT AS tokens FROM events
""")


def _events(spark, d):
    return sj.run_events(table(spark, d, "events"))


@query("progress_eta", with_("rev") + f"""
, t AS (SELECT run_id, count(*) FILTER (WHERE event_type IN ('call_succeeded', 'call_failed')) AS total FROM rev GROUP BY 1),
r AS (SELECT *, count(*) FILTER (WHERE event_type = 'call_succeeded') OVER w AS completed, count(*) FILTER (WHERE event_type = 'call_failed') OVER w AS failed,
        epoch_us(ts) / 1e6 - epoch_us(min(ts) OVER w) / 1e6 AS el FROM rev JOIN t USING (run_id) WINDOW w AS (PARTITION BY run_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
SELECT event_id, run_id, completed, failed, total, {rnd("CASE WHEN total <= 0 THEN 0e0 ELSE least(completed::DOUBLE / greatest(total, 1), 0.99e0) END")} AS progress, {rnd('el', 2)} AS elapsed_seconds,
       coalesce(CASE WHEN completed > 0 AND completed < total THEN {rnd('el / completed * (total - completed)', 2)} END, -1) AS eta_seconds FROM r""")
def progress_eta(spark, d):
    e = _events(spark, d)
    totals = e.groupBy("run_id").agg(F.count_if(F.col("event_type").isin("call_succeeded", "call_failed")).alias("total"))
    p = ru.progress_eta(e, totals)
    return p.select("event_id", "run_id", "completed", "failed", "total", half_even(F.col("progress"), 4).alias("progress"), "elapsed_seconds", F.coalesce("eta_seconds", F.lit(-1.0)).alias("eta_seconds"))


@query("running_best", with_("rev") + """
SELECT event_id, run_id, max(tokens) OVER w AS best_pass_count, min(loss) OVER w AS best_loss, sum(tokens) OVER w ::BIGINT AS total_tokens FROM rev WINDOW w AS (PARTITION BY run_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def running_best(spark, d):
    e = _events(spark, d).withColumn("pass_count", F.col("tokens"))
    return ru.running_best(e).select("event_id", "run_id", "best_pass_count", "best_loss", "total_tokens")


@query("latest_events", with_("rev") + """
SELECT run_id, event_id, event_type, loss FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY ts DESC, event_id DESC) AS r FROM rev) WHERE r = 1""")
def latest_events(spark, d):
    return ru.latest_per_key(_events(spark, d), ["run_id"], ["ts", "event_id"]).select("run_id", "event_id", "event_type", "loss")


@query("next_version", "SELECT event_type AS guideline_id, max(event_id) + 1 AS next_version FROM events GROUP BY 1")
def next_version(spark, d):
    return ru.next_version(table(spark, d, "events").select(F.col("event_type").alias("guideline_id"), F.col("event_id").alias("version")))


cte("crounds", """
SELECT run_id, dense_rank() OVER (PARTITION BY run_id ORDER BY day) AS round_index, min(loss) AS loss, max(k) AS pass_count, max(description_length) AS description_length, min(loss) < 2 AS reached_target FROM clog GROUP BY run_id, day
""", ["clog"])


def _rounds(spark, d):
    from pyspark.sql import Window as W

    r = candidate_log(spark, d).groupBy("run_id", "day").agg(F.min("loss").alias("loss"), F.max("k").alias("pass_count"), F.max("description_length").alias("description_length"))
    return r.select("run_id", F.row_number().over(W.partitionBy("run_id").orderBy("day")).alias("round_index"), "loss", "pass_count", "description_length", (F.col("loss") < 2).alias("reached_target"))


@query("round_deltas", with_("crounds") + f"""
, b AS (SELECT *, lag(loss) OVER w AS prev, coalesce(loss < min(loss) OVER (PARTITION BY run_id ORDER BY round_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS improved FROM crounds WINDOW w AS (PARTITION BY run_id ORDER BY round_index))
SELECT run_id, round_index, {rnd('coalesce(prev - loss, 0)')} AS loss_delta, improved, 'v' || sum(improved::INT) OVER (PARTITION BY run_id ORDER BY round_index ROWS UNBOUNDED PRECEDING) AS version_label FROM b""")
def round_deltas(spark, d):
    r = ru.round_deltas(_rounds(spark, d), ["run_id"])
    return r.select("run_id", F.col("round_index").cast("long").alias("round_index"), F.coalesce("loss_delta", F.lit(0.0)).alias("loss_delta"), "improved", "version_label")


@query("no_improvement_streak", with_("crounds") + """
, b AS (SELECT *, coalesce(loss < min(loss) OVER (PARTITION BY run_id ORDER BY round_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS improved FROM crounds),
i AS (SELECT *, sum(improved::INT) OVER (PARTITION BY run_id ORDER BY round_index ROWS UNBOUNDED PRECEDING) AS g FROM b),
s AS (SELECT *, row_number() OVER (PARTITION BY run_id, g ORDER BY round_index) - CASE WHEN g > 0 THEN 1 ELSE 0 END AS streak FROM i)
SELECT run_id, round_index, streak AS no_improvement_streak, CASE WHEN reached_target THEN 'reached_target' WHEN streak >= 5 THEN 'no_loss_improvement_patience' WHEN round_index >= 30 THEN 'max_rounds' ELSE '' END AS stop_reason FROM s""")
def no_improvement_streak(spark, d):
    r = ru.no_improvement(_rounds(spark, d), ["run_id"], 5, 30)
    return r.select("run_id", F.col("round_index").cast("long").alias("round_index"), F.col("no_improvement_streak").cast("long").alias("no_improvement_streak"), "stop_reason")


@query("best_result", with_("crounds") + """
SELECT run_id, round_index, loss, pass_count FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY NOT reached_target, loss, -pass_count, description_length, round_index) AS r FROM crounds) WHERE r = 1""")
def best_result(spark, d):
    return ru.best_result(_rounds(spark, d), ["run_id"]).select("run_id", F.col("round_index").cast("long").alias("round_index"), "loss", "pass_count")


@query("best_candidates", with_("clog") + """
, f AS (SELECT run_id, k AS description, min(event_id) AS idx, arg_min(loss, event_id) AS loss FROM clog GROUP BY 1, 2),
l AS (SELECT run_id, list({i: idx, loss: loss} ORDER BY idx) AS xs FROM f GROUP BY 1)
SELECT run_id, coalesce(r.id, 'current') AS selected_candidate_id, r.loss AS selected_loss, r.n AS accepted_count
FROM (SELECT run_id, list_reduce(xs, lambda a, x: CASE WHEN x.loss + 5e0 < a.loss THEN {id: 'cand-' || x.i, loss: x.loss, n: a.n + 1} ELSE a END, {id: NULL::VARCHAR, loss: 100e0, n: 0::BIGINT}) AS r
      FROM (SELECT run_id, list_transform(xs, lambda x: {i: x.i, loss: x.loss}) AS xs FROM l))""")
def best_candidates(spark, d):
    e = candidate_log(spark, d).select(
        "run_id", F.col("k").cast("string").alias("description"), F.col("event_id").alias("evaluation_index"), F.concat(F.lit("cand-"), F.col("event_id").cast("string")).alias("candidate_id"), "loss"
    )
    return ru.best_candidates(e, ["run_id"], 100.0, 5.0)


METHODS = ["view", "click", "purchase", "error", "signup"]


@query("select_best_method", with_("clog") + """
, m AS (SELECT run_id, method, min(loss) AS best_loss, max(description_length) AS dl, count(*) AS rc, min(loss) < 5 AS reached, bool_and(memorization_passed) AS mp FROM clog GROUP BY 1, 2)
SELECT run_id, method, best_loss FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY NOT (reached AND mp), best_loss, dl, rc, list_position(['view', 'click', 'purchase', 'error', 'signup'], method)) AS r FROM m) WHERE r = 1""")
def select_best_method(spark, d):
    m = candidate_log(spark, d).groupBy("run_id", "method").agg(
        F.min("loss").alias("best_loss"), F.max("description_length").alias("description_length"), F.count(F.lit(1)).alias("round_count"), (F.min("loss") < 5).alias("reached_target"),
        F.bool_and("memorization_passed").alias("memorization_passed"),
    )
    return ru.select_best_method(m, METHODS, ["run_id"]).select("run_id", "method", "best_loss")


@query("mask_ablation", with_("clog") + f"""
, c AS (SELECT run_id, max(loss) AS current_loss FROM clog WHERE NOT mask GROUP BY 1)
SELECT event_id, l.run_id, {rnd('l.loss - c.current_loss')} AS mask_loss_delta, CASE WHEN {rnd('l.loss - c.current_loss')} > 0.5 THEN 'high_contribution_keep_or_refine' WHEN {rnd('l.loss - c.current_loss')} < -0.5 THEN 'negative_contribution_rewrite_or_remove' ELSE 'low_or_uncertain_contribution_small_step' END AS mask_interpretation,
  row_number() OVER (PARTITION BY l.run_id ORDER BY {rnd('l.loss - c.current_loss')} DESC, event_id) AS mask_rank
FROM clog l JOIN c USING (run_id) WHERE mask""")
def mask_ablation(spark, d):
    log = candidate_log(spark, d)
    current = log.where("mask_segment_id IS NULL").groupBy("run_id").agg(F.max("loss").alias("loss"))
    m = ru.mask_ablation(log.where("mask_segment_id IS NOT NULL").select("event_id", "run_id", "loss"), current, ["run_id"])
    return m.select("event_id", "run_id", "mask_loss_delta", "mask_interpretation", F.col("mask_rank").cast("long").alias("mask_rank"))


@query("segment_scores", with_("segs") + f"""
, s AS (SELECT *, doc_id % 7 AS m, doc_id % 5 AS x, doc_id % 3 + doc_id % 2 * 0.5e0 + doc_id % 11 * 0.05e0 AS b FROM segs WHERE kind NOT IN ('output_format', 'label_schema')),
t AS (SELECT *, CASE kind WHEN 'boundary_rules' THEN b + m * 1.2e0 + x WHEN 'negative_rules' THEN b * 0.7e0 + x * 1.5e0 WHEN 'task_definition' THEN b * 0.8e0 + m ELSE b * 0.4e0 END AS w FROM s)
SELECT doc_id, printf('seg-%02d-%s', index, kind) AS segment_id, {rnd('w')} AS score, CASE kind WHEN 'negative_rules' THEN CASE WHEN x >= m THEN 'tighten_exclusions' ELSE 'keep_exclusions' END
  WHEN 'boundary_rules' THEN CASE WHEN m > x THEN 'expand_recall_boundary' WHEN x > m THEN 'tighten_boundary' ELSE 'stabilize_boundary' END WHEN 'task_definition' THEN 'clarify_task_scope' ELSE 'minimal_revision' END AS direction FROM t WHERE w > 0""")
def segment_scores(spark, d):
    s = documents(spark, d).select("doc_id", F.explode(tx.segment_text(F.col("text"), HEADINGS)).alias("s")).select("doc_id", "s.*")
    doc = F.col("doc_id")
    r = ru.segment_scores(s, doc % 7, doc % 5, doc % 3, doc % 2, (doc % 11).cast("double"))
    return r.select("doc_id", F.col("id").alias("segment_id"), half_even(F.col("score"), 4).alias("score"), "direction")


@query("stream_progress", with_("rev") + "SELECT run_id, event_type, count(*) AS event_count, sum(tokens)::BIGINT AS tokens, min(loss) AS best_loss FROM rev GROUP BY 1, 2")
def stream_progress(spark, d):
    return sj.live_progress(_events(spark, d)).drop("last_ts")


@query("stream_throughput", with_("rev") + f"""
SELECT epoch_us(s) // 1000000 AS window_start, count(*) AS completed, {rnd('1000e0 * 60 / count(*)', 2)} AS eta_seconds FROM (SELECT ts, unnest(list_transform(range(0, 6), lambda i: time_bucket(INTERVAL 10 SECOND, ts) - to_seconds(10 * i))) AS s FROM rev WHERE event_type = 'call_succeeded') GROUP BY s""")
def stream_throughput(spark, d):
    r = sj.eta_from_throughput(sj.throughput(_events(spark, d)), 1000)
    return r.select(F.unix_seconds("window_start").alias("window_start"), "completed", "eta_seconds")


@query("stale_runs", with_("rev") + """
SELECT run_id, epoch_us(min(ts)) AS started_at, epoch_us(max(ts)) + 120000000 AS stale_at, count(*) AS event_count FROM (
  SELECT *, sum(n) OVER (PARTITION BY run_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY run_id ORDER BY ts, event_id) <= 120000000 THEN 0 ELSE 1 END AS n FROM rev)) GROUP BY run_id, g""")
def stale_runs(spark, d):
    s = sj.active_sessions(_events(spark, d))
    return s.select("run_id", F.unix_micros("started_at").alias("started_at"), F.unix_micros("stale_at").alias("stale_at"), "event_count")


NOW = "2024-01-30 12:00:00"


@query("idle_runs", with_("rev") + f"""
SELECT run_id, epoch_us(max(ts)) AS last_at, (epoch(TIMESTAMP '{NOW}') - epoch(date_trunc('second', max(ts))))::BIGINT AS idle_seconds FROM rev WHERE ts < TIMESTAMP '{NOW}' GROUP BY 1
HAVING (epoch(TIMESTAMP '{NOW}') - epoch(date_trunc('second', max(ts))))::BIGINT > 120""")
def idle_runs(spark, d):
    """Runs that at a given time had no event for longer than the limit."""
    s = sj.stale_runs(_events(spark, d).where(F.col("ts") < F.lit(NOW).cast("timestamp")), NOW)
    return s.select("run_id", F.unix_micros("last_ts").alias("last_at"), F.col("idle_seconds").cast("long").alias("idle_seconds"))


def _feed(spark, d, place):
    """The events as a folder of four files, written one after the other by ``place`` (0 to below 1), and room for the stream's state."""
    base = f"{checkpoint_dir(spark)}/feed-{uuid.uuid4().hex}"
    events = table(spark, d, "events").withColumn("piece", F.floor(place * 4))
    for k in range(4):  # a stream takes files by the time they were written
        events.where(F.col("piece") == k).drop("piece").write.mode("append").parquet(f"{base}/events")
    return base


@query("task_state", """
SELECT kind, item_id, status, value, updated_at, event_id FROM (SELECT *, row_number() OVER (PARTITION BY kind, item_id ORDER BY updated_at DESC, event_id DESC) AS r FROM (
  SELECT CASE WHEN event_type IN ('purchase', 'error') THEN 'review' ELSE 'task' END AS kind, user_id AS item_id, value, epoch_us(ts) AS updated_at, event_id,
    CASE event_type WHEN 'purchase' THEN 'accepted' WHEN 'error' THEN 'rejected' WHEN 'signup' THEN 'created' ELSE 'pending' END AS status FROM events)) WHERE r = 1""")
def task_state(spark, d):
    """State of tasks and reviews after a feed of changes, batch by batch, in an order that has nothing to do with their versions."""
    base = _feed(spark, d, F.pmod(F.xxhash64("event_id"), F.lit(1000)) / 1000)
    changes = sj.task_changes(sj.read_events(spark, f"{base}/events"))
    sj.upsert_stream(changes, f"{base}/state", ["kind", "item_id"], ["updated_at", "event_id"], f"{base}/stream").awaitTermination()
    return read_state(spark, f"{base}/state", changes.schema)


@query("silence_alerts", with_("rev") + """
, s AS (SELECT run_id, min(ts) AS a, max(ts) AS b, count(*) AS event_count FROM (
  SELECT *, sum(n) OVER (PARTITION BY run_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY run_id ORDER BY ts, event_id) <= 120000000 THEN 0 ELSE 1 END AS n FROM rev)) GROUP BY run_id, g)
SELECT run_id, epoch_us(a) AS started_at, epoch_us(b) AS last_at, epoch_us(b) + 120000000 AS alert_at, event_count FROM s WHERE (epoch_us(b) + 120000000) // 1000 + 1 < (SELECT epoch_us(max(ts)) // 1000 - 600000 FROM rev)""")
def silence_alerts(spark, d):
    """What the running stream has reported once it has seen all events, four files one after the other."""
    first, last = table(spark, d, "events").selectExpr("unix_micros(CAST(min(ts) AS TIMESTAMP))", "unix_micros(CAST(max(ts) AS TIMESTAMP))").first()
    base = _feed(spark, d, (F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(first)) / F.lit(float(max((last or 0) - (first or 0), 1)) * (1 + 1e-9)))
    alerts = sa.silence_alerts(sj.run_events(sj.read_events(spark, f"{base}/events")))
    alerts.writeStream.format("parquet").option("path", f"{base}/alerts").option("checkpointLocation", f"{base}/stream").trigger(availableNow=True).start().awaitTermination()
    a = spark.read.schema(alerts.schema).parquet(f"{base}/alerts")
    us = lambda c: F.unix_micros(c)
    return a.select("run_id", us("started_at").alias("started_at"), us("last_ts").alias("last_at"), us("alert_at").alias("alert_at"), "event_count")


@query("history_export", """
SELECT conv_id, history_count, chars FROM (SELECT conv_id, count(*) AS history_count, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY 1)""")
def history_export(spark, d):
    r = rep.history_export(table(spark, d, "conversations"), "2024-01-01 00:00:00", "conv_id", "turn")
    j = F.from_json("value", "exported_at string, history_count bigint, history array<struct<role:string,text:string>>")
    r = r.select("conv_id", j.alias("j"))
    return r.select("conv_id", "j.history_count", F.aggregate("j.history", F.lit(0).cast("long"), lambda a, x: a + F.length(x["text"])).alias("chars"))


_PLAIN = lambda x: f"regexp_replace(regexp_replace(CAST(CAST({x} AS DECIMAL(38,4)) AS VARCHAR), '0+$', ''), '[.]$', '.0')"
_FIXED = lambda rows: "(VALUES " + ", ".join(f"({no}, '{section}', '{at}', '{line}')" for no, section, at, line in rows) + ") AS f(section_no, section, \"at\", line)"
_DOWN = lambda n: f"printf('%019d', 1000000000000000000 - {n})"
_SUMMARY = {
    "task_count": "(SELECT count(*) FROM tfinal)", "prediction_count": "(SELECT count(*) FROM runs3)", "review_count": "(SELECT count(*) FROM rfinal)",
    "pending_review_count": "(SELECT count(*) FROM rfinal WHERE status = 'pending')",
    "auto_accept_rate": _PLAIN(f"(SELECT {rnd("count(*) FILTER (WHERE route = 'auto_accept')::DOUBLE / count(*)")} FROM tfinal)"),
    "review_rate": _PLAIN(f"(SELECT {rnd("count(*) FILTER (WHERE route = 'review')::DOUBLE / count(*)")} FROM tfinal)"),
    "hard_example_count": "(SELECT count(*) FROM tfinal WHERE hard_example)", "manual_edit_count": "(SELECT count(*) FROM rfinal WHERE manually_edited)",
    "promoted_to_gold_count": "(SELECT count(*) FROM tfinal WHERE promote_to_gold)",
    "avg_agreement": _PLAIN(f"(SELECT {rnd('sum(CAST(round(agreement * 10000) AS BIGINT))::DOUBLE / (count(*) * 1e4)')} FROM tfinal)"),
    "avg_span_length": _PLAIN(f"(SELECT {rnd('sum(en - st)::DOUBLE / count(*)', 2)} FROM tspans WHERE st >= 0)"),
}
_DATASET_LINES = f"""
SELECT * FROM {_FIXED([(0, 'title', ' 00', '# ' + wording.DATASET_TITLE), (0, 'title', ' 01', ''), (2, wording.LABELS_TITLE, ' 00', ''), (2, wording.LABELS_TITLE, ' 01', '## ' + wording.LABELS_TITLE),
  (3, wording.ROUTES_TITLE, ' 00', ''), (3, wording.ROUTES_TITLE, ' 01', '## ' + wording.ROUTES_TITLE)])}
""" + "".join(f"UNION ALL SELECT 1, 'summary', '{i:02d}', '- {name}: ' || {_SUMMARY[c]}\n" for i, (name, c) in enumerate(wording.SUMMARY_LINES)) + f"""
UNION ALL SELECT 2, '{wording.LABELS_TITLE}', {_DOWN('count(*)')} || '|' || label, '- ' || label || ': ' || count(*) FROM tspans GROUP BY label
UNION ALL SELECT 3, '{wording.ROUTES_TITLE}', {_DOWN('count(*)')} || '|' || route, '- ' || route || ': ' || count(*) FROM tfinal GROUP BY route"""


@query("dataset_report", with_("tfinal", "tspans", "rfinal", "runs3") + _DATASET_LINES)
def dataset_report(spark, d):
    return rep.dataset_report(*work_tables(spark, d))


@query("experiment_report", with_("tfinal", "tspans", "rfinal", "runs3") + _DATASET_LINES + f"""
UNION ALL SELECT * FROM {_FIXED([(n, t, f' 0{i}', x) for n, t in ((4, wording.VERSIONS_TITLE), (5, wording.FEEDBACK_TITLE)) for i, x in enumerate(('', '## ' + t))])}
UNION ALL SELECT 4, '{wording.VERSIONS_TITLE}', printf('%019d', event_id), '- v' || event_id || ': pass=' || k || ', failed=' || k % 4 || ', unstable=' || k % 3 || ', round=' || user_id FROM (SELECT *, (props->>'$.k')::BIGINT AS k FROM events WHERE event_type = 'signup')
UNION ALL SELECT 5, '{wording.FEEDBACK_TITLE}', {_DOWN('count(*)')} || '|' || error_type, '- ' || error_type || ': ' || count(*) FROM rfinal WHERE error_type <> '' GROUP BY error_type""")
def experiment_report(spark, d):
    tasks, p, reviews, j = work_tables(spark, d)
    reviews = kept(reviews)
    return rep.experiment_report(rep.dataset_report(tasks, p, reviews, j), versions(spark, d), reviews)


@query("method_report", with_("clog") + f"""
, m AS (SELECT method, count(*) FILTER (WHERE status = 'evaluated') AS n, count(*) FILTER (WHERE accepted) AS a, count(*) FILTER (WHERE status <> 'evaluated') AS b, min(loss) FILTER (WHERE status = 'evaluated') AS best, sum(k)::BIGINT AS t, sum(repair_attempts)::BIGINT AS r FROM clog GROUP BY 1),
w AS (SELECT method, best FROM m ORDER BY best NULLS LAST, method LIMIT 1)
SELECT * FROM {_FIXED([(0, 'title', f' {i:02d}', x) for i, x in enumerate(['# ' + wording.COMPARISON_TITLE, '', '## Summary', '', '- Experiment case: `custom`'])] + [(2, 'Summary', ' 00', wording.BEST_NOTE)]
  + [(n, t, f' {i:02d}', x) for n, t, head in ((3, 'Method Comparison', rep.METHOD_COLUMNS), (4, 'Candidate Status', rep.CANDIDATE_COLUMNS)) for i, x in enumerate(['', '## ' + t, '', *rep.table_head(head)])])}
UNION ALL SELECT 1, 'Summary', '1', '- Best method: `' || method || '`' FROM w UNION ALL SELECT 1, 'Summary', '2', '- Best loss: `' || {_PLAIN('best')} || '`' FROM w
UNION ALL SELECT 3, 'Method Comparison', method, '| ' || concat_ws(' | ', method, n, a, b, {_PLAIN('best')}, t, r) || ' |' FROM m
UNION ALL SELECT 4, 'Candidate Status', method || '|' || printf('%019d', run_id) || '|' || printf('%019d', event_id), '| ' || concat_ws(' | ', method, run_id, event_id, status, {_PLAIN('loss')}, CASE WHEN memorization_passed THEN 'clean' ELSE 'blocked' END, repair_attempts) || ' |' FROM clog""")
def method_report(spark, d):
    log = candidate_log(spark, d).withColumns({"tokens": F.col("k"), "round": F.col("run_id"), "candidate_id": F.col("event_id")})
    return rep.comparison_report(log)
