"""Annotation tables derived from the driver tables.

The driver tables hold no spans, so gold spans are the long words of each whole text, labelled by a digest of the word;
three candidate runs drop or relabel some of them by digest. Both engines can state the same rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..schema import SPAN_DDL
from ..session import kept


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hex1(col: Column) -> Column:
    return F.substring(F.md5(col), 1, 1)


def joined(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def span(id_: Column, start: Column, end: Column, text: Column, label: Column, implicit: Column) -> Column:
    return F.struct(
        id_.alias("id"), start.cast("int").alias("start"), end.cast("int").alias("end"), text.alias("text"),
        label.alias("label"), implicit.alias("implicit"),
    )


def _label(word: Column) -> Column:
    # One digest a word: its first digit becomes the letter.
    return F.concat(F.lit("Term_"), F.translate(hex1(F.lower(word)), "0123456789abcdef", "AAAAAAAABBBBCCCC"))


def gold_spans(text: Column, doc_id: Column) -> Column:
    long_words = tx.tokenize_words(text, lower=False, least=8)
    explicit = F.transform(
        long_words,
        lambda w, i: span(F.concat(F.lit("T"), (i + 1).cast("string")), w["start"], w["end"], w["text"], _label(w["text"]), F.lit(False)),
    )
    implied = F.when(
        hex1(joined("imp|", doc_id)) < "4",
        F.array(span(F.lit("TI"), F.lit(-1), F.lit(-1), F.lit("implied"), F.lit("Term_I"), F.lit(True))),
    ).otherwise(F.array().cast(f"array<{SPAN_DDL}>"))
    return F.concat(explicit, implied)


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir)
    return d.select(
        F.format_string("s%08d", "doc_id").alias("id"), "doc_id", "lang", "source", "text",
        gold_spans(F.col("text"), F.col("doc_id")).alias("spans"),
    )


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir).select(F.col("id").alias("sample_id"), "doc_id", "text", "spans")
    s = s.withColumn("run", F.explode(F.array(*[F.lit(r).cast("long") for r in (1, 2, 3)])))
    doc, run = F.col("doc_id"), F.col("run")
    digit = lambda x: hex1(joined(doc, "|", run, "|", x["start"]))
    fixed = hex1(joined("fix|", doc)) < "6"
    # One digest a span, and none where the document's answer is fixed.
    told = F.filter(F.transform("spans", lambda x: F.struct(x.alias("x"), digit(x).alias("d"))), lambda t: t["d"] >= "2")
    changed = F.transform(told, lambda t: span(*[t["x"][c] for c in ("id", "start", "end", "text")], F.when(t["d"] == "f", "Term_X").otherwise(t["x"]["label"]), t["x"]["implicit"]))
    relabelled = F.when(fixed, F.col("spans")).otherwise(changed)
    step = F.conv(F.substring(F.md5(joined("conf|", doc, "|", run)), 1, 4), 16, 10).cast("long") % 11
    conf = F.when(hex1(joined("none|", doc, "|", run)) < "2", F.lit(None)).otherwise((step + 10) / F.lit(20.0))
    return s.select(
        "sample_id", F.format_string("c%d", "run").alias("candidate_id"), "run", "doc_id", "text",
        relabelled.alias("spans"), conf.cast("double").alias("model_confidence"),
    )


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt out by key before their texts are taken apart, so that what is made of a text is made where there is room.

    The same exchange at every size; adaptive execution merges partitions that come out small.
    """
    return df.repartition(key)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"), "doc_id")


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model responses of all candidates: well-formed, fenced, truncated, incomplete or with a document, by digest."""
    from ..functions.markup import annotation_doc, spans_to_markup

    c = candidates(spark, sf_dir)
    h = hex1(joined("resp|", F.col("doc_id"), "|", F.col("run")))
    markup = F.when(h == "7", F.lit("")).when(h == "6", F.lit("[old](Term)")).otherwise(spans_to_markup(F.col("spans")))
    c = c.select("*", h.alias("h"), markup.alias("markup"))
    expl = F.when(F.col("h") == "3", F.lit(" ")).otherwise(F.lit("long words"))
    conf = F.col("model_confidence")
    doc = annotation_doc(F.when(F.col("h") == "5", F.concat("text", F.lit("!"))).otherwise(F.col("text")), F.col("spans"))
    plain = F.to_json(F.struct("text", F.col("markup").alias("annotation"), expl.alias("explanation"), conf.alias("confidence")))
    partial = F.to_json(F.struct("text", F.col("markup").alias("annotation"), conf.alias("model_confidence")))
    full = F.to_json(F.struct("text", doc.alias("annotation"), expl.alias("explanation"), conf.alias("model_confidence")))
    raw = (
        F.when(F.col("h") == "0", F.substring(plain, F.lit(1), F.length(plain) - 5))
        .when(F.col("h") == "1", F.concat(F.lit("```json\n"), plain, F.lit("\n```")))
        .when(F.col("h") == "2", partial)
        .when(F.col("h").isin("4", "5"), full)
        .otherwise(plain)
    )
    return c.select("sample_id", "candidate_id", "run", "doc_id", "text", "spans", "h", "model_confidence", raw.alias("raw"))


def dirty_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold tasks with some spans broken by digest, plus relations and options of which some point nowhere."""
    s = samples(spark, sf_dir)
    doc, n = F.col("doc_id"), F.length("text")
    h = lambda x: hex1(joined("dirty|", doc, "|", x["start"]))
    broken = F.transform(
        "spans",
        lambda x: span(
            F.when(h(x) == "4", "T1").otherwise(x["id"]),
            F.when((h(x) == "0") & ~x["implicit"], x["start"] + 1).otherwise(x["start"]),
            F.when((h(x) == "0") & ~x["implicit"], x["end"] + 1).when((h(x) == "2") & ~x["implicit"], n + 5).otherwise(x["end"]),
            F.when(h(x) == "5", "").otherwise(x["text"]),
            F.when(h(x) == "1", " ").otherwise(x["label"]),
            (h(x) == "3") | x["implicit"],
        ),
    )
    d = hex1(joined("refs|", doc))
    rel = lambda i, lab, a, b: F.struct(
        F.lit(i).alias("id"), F.lit(lab).alias("label"), a.alias("head_span_id"), b.alias("child_span_id"),
        F.lit(None).cast("int").alias("head"), F.lit(None).cast("int").alias("child"),
    )
    null = F.lit(None).cast("string")
    relations = F.array(
        rel("R1", "links", F.lit("T1"), F.lit("T2")),
        rel("R2", "links", F.lit("T1"), F.when(d < "3", "T99999").otherwise("T1")),
        rel("R3", "links", F.when(d > "c", null).otherwise(F.lit("T1")), F.lit("T1")),
    )
    option = lambda i: F.struct(F.lit(i).alias("id"), F.lit(f"option {i}").alias("text"))
    return s.select(
        "id", "doc_id", "lang", "source", "text", broken.alias("spans"), F.when(F.size("spans") > 0, relations).otherwise(F.slice(relations, 1, 0)).alias("relations"),
        F.array(option("A"), option("B")).alias("options"), F.array(F.when(d == "7", "Z").otherwise("A")).alias("accept"),
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates as predictions of one batch job; the rule risk is set by digest."""
    c = candidates(spark, sf_dir)
    h = hex1(joined("risk|", F.col("doc_id"), "|", F.col("run")))
    return c.select(
        F.concat_ws("-", F.lit("pred"), "sample_id", F.col("run").cast("string")).alias("prediction_id"), F.col("sample_id").alias("task_id"), "doc_id", "run",
        F.lit("batch").alias("source"), F.lit("local-rule").alias("model"), "text", "spans", F.col("model_confidence").alias("score"),
        F.when(h == "0", 1.0).when(h == "1", 0.25).otherwise(0.0).alias("rule_risk"),
    )


def routed_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.review import route_tasks

    return route_tasks(predictions(spark, sf_dir), "job-1")


def routed_predictions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Predictions without their texts and the routes of their tasks, both kept: spans are found and scored once for all that reads them."""
    from ..operators.review import route_tasks

    p = kept(predictions(spark, sf_dir).drop("text"))
    return p, kept(route_tasks(p, "job-1"))


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.review import build_reviews

    return build_reviews(routed_tasks(spark, sf_dir))


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review decisions from the quality labels: toxic texts are rejected, good ones accepted, some edited by hand."""
    lab, doc = table(spark, sf_dir, "labels"), F.col("doc_id")
    accept = (F.col("toxic") != 1) & (doc % 13 != 0) & (F.col("quality") == 1)
    manual = (F.col("toxic") != 1) & (doc % 13 == 0)
    decision = F.when(F.col("toxic") == 1, "reject").when(manual, "manual").when(F.col("quality") == 1, "accept").otherwise("skip")
    hand = F.array(span(F.lit("T1"), F.lit(-1), F.lit(-1), F.lit("by hand"), F.lit("Term_A"), F.lit(True)))
    return lab.select(
        F.format_string("review-s%08d", "doc_id").alias("review_id"), decision.alias("decision"),
        F.when(accept, F.char(65 + doc % 3)).alias("selected_option_id"), F.when(manual, hand).alias("manual_spans"),
        F.concat(F.lit("note "), doc.cast("string")).alias("note"), (doc % 4 == 0).alias("hard_example"),
        F.when(doc % 5 == 0, "boundary").otherwise("").alias("error_type"), (doc % 6 == 0).alias("promote_to_gold"),
    )


def gold_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document names a small gold set of its language's guideline; some listed tasks do not exist."""
    doc = F.col("doc_id")
    task = lambda c: F.format_string("s%08d", c)
    return table(spark, sf_dir, "documents").select(
        F.format_string("gold-%08d", doc).alias("gold_set_id"), F.concat(F.lit("guide-"), F.col("lang")).alias("guideline_id"), doc.alias("created_at"),
        F.array(task(doc), task(doc * 2 + 1)).alias("task_ids"), F.lit(15).alias("target_count"),
    )


def guidelines(spark: SparkSession, sf_dir: str) -> DataFrame:
    langs = table(spark, sf_dir, "documents").select("lang").distinct()
    return langs.select(F.concat(F.lit("guide-"), F.col("lang")).alias("guideline_id"), F.concat(F.lit("Long words, "), F.col("lang")).alias("name"))


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    langs = table(spark, sf_dir, "documents").select("lang").distinct()
    return langs.select(
        F.concat(F.lit("job-"), F.col("lang")).alias("job_id"), F.concat(F.lit("guide-"), F.col("lang")).alias("guideline_id"), F.lit("completed").alias("status")
    )


def decided_reviews(spark: SparkSession, sf_dir: str, work: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """All reviews with the state their decision left them in; ``work`` is what ``routed_predictions`` gave, if it is at hand."""
    from ..operators.review import apply_decisions, build_reviews

    p, routed = work or routed_predictions(spark, sf_dir)
    r = build_reviews(routed).withColumn("hard_example", F.lit(False))
    t = samples(spark, sf_dir).select("id", "spans").withColumn("source_pool", F.lit("review"))
    a = apply_decisions(r, decisions(spark, sf_dir), t, p).select(
        "review_id", F.col("status").alias("s"), F.col("manually_edited").alias("m"), F.col("review_hard_example").alias("h"), "error_type", "review_note"
    )
    no = F.lit(False)
    return r.drop("hard_example").join(a, "review_id", "left").select(
        "review_id", "task_id", "job_id", "score", "route_reason", "created_at", F.coalesce("s", "status").alias("status"), F.coalesce("m", no).alias("manually_edited"),
        F.coalesce("h", no).alias("hard_example"), F.coalesce("error_type", F.lit("")).alias("error_type"), F.coalesce("review_note", F.lit("")).alias("review_note"),
    )


def annotated_tasks(spark: SparkSession, sf_dir: str, work: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Tasks after routing and review: spans of the best prediction, or what the decision chose; ``work`` as in ``decided_reviews``."""
    from ..operators.review import apply_decisions, build_reviews

    p, routed = work or routed_predictions(spark, sf_dir)
    best = p.select(F.col("prediction_id").alias("best_prediction_id"), F.col("spans").alias("best_spans"))
    docs = samples(spark, sf_dir)
    base = routed.join(best, "best_prediction_id").join(docs.select(F.col("id").alias("task_id"), "doc_id", F.col("source").alias("project_id"), "text"), "task_id")
    t = base.select(F.col("task_id").alias("id"), F.col("best_spans").alias("spans"), "source_pool")
    a = apply_decisions(build_reviews(routed).withColumn("hard_example", F.lit(False)), decisions(spark, sf_dir), t, p).where("task_answer IS NOT NULL").select(
        "task_id", "task_answer", "task_spans", "task_source_pool", "task_hard_example", "promote_to_gold"
    )
    no = F.lit(False)
    return base.join(a, "task_id", "left").select(
        F.col("task_id").alias("id"), "doc_id", "project_id", "text", F.coalesce("task_spans", "best_spans").alias("spans"), "route", "score", "agreement", "avg_confidence",
        F.col("task_answer").isNotNull().alias("reviewed"), F.coalesce("task_hard_example", no).alias("hard_example"), F.coalesce("promote_to_gold", no).alias("promote_to_gold"),
        F.coalesce("task_source_pool", "source_pool").alias("source_pool"), F.coalesce("task_answer", "answer").alias("answer"),
    )


def event_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concept versions out of the signup events; the sizes of their lists come from the event's number."""
    k = F.col("k")
    ids = lambda n: F.slice(F.array(*[F.lit(f"task-{i}") for i in range(4)]), 1, (k % n).cast("int"))
    e = event_numbers(spark, sf_dir).where("event_type = 'signup'")
    return e.select(
        F.col("event_id").alias("version"), k.alias("pass_count"), ids(4).alias("failed_task_ids"), ids(3).alias("unstable_task_ids"), F.col("user_id").alias("round_index"),
        F.col("ts").alias("created_at"), F.when(k % 10 == 0, F.concat(F.lit("failed "), k.cast("string"))).alias("failure_summary"),
    )


def candidate_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate evaluations of optimisation runs, one per event; the run is the user, the round the day."""
    k = F.col("k")
    text = lambda cond, name: F.when(cond, F.concat(F.lit(name), k.cast("string")))
    return event_numbers(spark, sf_dir).select(
        "event_id", F.col("user_id").alias("run_id"), F.col("event_type").alias("method"), F.date_trunc("day", "ts").alias("day"), "ts", "k", F.col("value").alias("loss"),
        (k + 100).alias("description_length"), F.when(k < 10, "memorization_guard_blocked").when(k < 20, "memorization_repair_failed").otherwise("evaluated").alias("status"),
        (k % 3).alias("repair_attempts"), (k >= 20).alias("memorization_passed"), (k % 4 == 0).alias("accepted"), text(k % 2 == 0, "critic ").alias("critic_diagnosis"),
        text(k % 3 == 0, "turn ").alias("controller_direction"), text(k % 5 == 0, "seg-").alias("mask_segment_id"), F.when(k % 5 == 0, F.col("value") - 50).alias("mask_loss_delta"),
    )


def work_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Annotated tasks, predictions, decided reviews and jobs, out of one pass over the documents: spans are found once and kept.

    What is kept has no texts. Routes, reviews and decisions are worked out from it.
    """
    from ..operators.review import apply_decisions, build_reviews

    p, routed = routed_predictions(spark, sf_dir)
    r = build_reviews(routed).withColumn("hard_example", F.lit(False))
    best = p.select(F.col("prediction_id").alias("best_prediction_id"), F.col("spans").alias("best_spans"))
    base = routed.join(best, "best_prediction_id")
    t = base.select(F.col("task_id").alias("id"), F.col("best_spans").alias("spans"), "source_pool")
    a = apply_decisions(r, decisions(spark, sf_dir), t, p).checkpoint()
    no = F.lit(False)
    won = a.where("task_answer IS NOT NULL").select("task_id", "task_spans", "task_hard_example", "promote_to_gold")
    tasks = base.join(won, "task_id", "left").select(
        F.col("task_id").alias("id"), "route", "agreement", F.coalesce("task_spans", "best_spans").alias("spans"),
        F.coalesce("task_hard_example", no).alias("hard_example"), F.coalesce("promote_to_gold", no).alias("promote_to_gold"))
    state = a.select("review_id", F.col("status").alias("s"), F.col("manually_edited").alias("m"), "error_type")
    reviews_ = r.join(state, "review_id", "left").select(
        "review_id", F.coalesce("s", "status").alias("status"), F.coalesce("m", no).alias("manually_edited"), F.coalesce("error_type", F.lit("")).alias("error_type"))
    return tasks, p, reviews_, jobs(spark, sf_dir)
