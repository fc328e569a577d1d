"""Validators. Bad rows are kept and reported; each validator yields an issue table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import let, strip
from ..functions.markup import markup_issue, parse_markup
from ..functions.responses import doc_issue
from .stats import one_row


def span_issue(span: Column, text: Column) -> Column:
    """NULL for a valid span, else the first rule it breaks."""
    start, end = span["start"], span["end"]
    return (
        F.when(strip(span["text"]) == "", "empty_text")
        .when(strip(span["label"]) == "", "empty_label")
        .when(span["implicit"] & ((start != -1) | (end != -1)), "implicit_offsets")
        .when(span["implicit"], F.lit(None).cast("string"))
        .when((start < 0) | (end <= start), "bad_offsets")
        .when(end > F.length(text), "out_of_range")
        .when(F.substring(text, start + 1, end - start) != span["text"], "text_mismatch")
    )


def _named(span: Column, index: Column) -> Column:
    return F.coalesce(F.nullif(span["id"], F.lit("")), F.concat(F.lit("T"), (index + 1).cast("string")))


def repeated(items: Column) -> Column:
    """Values that occur more than once, by sorting inside the row."""
    return let(
        F.array_sort(items),
        lambda s: F.array_distinct(F.filter(s, lambda x, i: (i > 0) & (x == F.get(s, i - 1)))),
    )


def validate_spans(tasks: DataFrame) -> DataFrame:
    """(task_id, span_id, issue_code): broken spans and repeated span ids. Works inside the row, without a shuffle."""
    ids = F.transform("spans", _named)
    broken = F.filter(
        F.transform("spans", lambda s, i: F.struct(_named(s, i).alias("span_id"), span_issue(s, F.col("text")).alias("issue_code"))),
        lambda x: x["issue_code"].isNotNull(),
    )
    twice = F.transform(repeated(ids), lambda x: F.struct(x.alias("span_id"), F.lit("duplicate_id").alias("issue_code")))
    return tasks.select(F.col("id").alias("task_id"), F.explode(F.concat(broken, twice)).alias("i")).select("task_id", "i.span_id", "i.issue_code")


def validate_refs(tasks: DataFrame) -> DataFrame:
    """(task_id, ref, issue_code): relations and accepted options that point nowhere."""
    ids = F.transform("spans", _named)
    row = lambda ref, code: F.struct(ref.alias("ref"), F.lit(code).alias("issue_code"))
    # Relation ends against span ids by hashing, not by scanning the spans for each relation.
    ends = lambda field: F.filter(F.transform("relations", lambda r: r[field]), lambda x: F.coalesce(x, F.lit("")) != "")
    loose = F.filter(
        "relations",
        lambda r: ~((F.coalesce(r["head_span_id"], F.lit("")) != "") & (F.coalesce(r["child_span_id"], F.lit("")) != ""))
        & (r["head"].isNull() | r["child"].isNull()),
    )
    issues = F.concat(
        F.transform(loose, lambda r: row(r["id"], "relation_without_reference")),
        F.transform(F.filter("relations", lambda r: strip(r["label"]) == ""), lambda r: row(r["id"], "relation_without_label")),
        F.transform(F.array_except(ends("head_span_id"), ids), lambda x: row(x, "unknown_head")),
        F.transform(F.array_except(ends("child_span_id"), ids), lambda x: row(x, "unknown_child")),
        F.transform(
            F.when(F.size("options") > 0, F.array_except("accept", F.transform("options", lambda o: o["id"]))).otherwise(F.array().cast("array<string>")),
            lambda x: row(x, "unknown_accept"),
        ),
    )
    return tasks.select(F.col("id").alias("task_id"), F.explode(issues).alias("i")).select("task_id", "i.ref", "i.issue_code")


def validate_markup(df: DataFrame, markup: str = "markup") -> DataFrame:
    return df.withColumn("issue_code", markup_issue(F.col(markup)))


def validate_documents(df: DataFrame, doc: str = "doc") -> DataFrame:
    """Adds ``issue_code`` for a JSON annotation document."""
    return df.withColumn("issue_code", let(F.try_parse_json(F.col(doc)), lambda v: F.when(v.isNull(), "invalid_json").otherwise(doc_issue(v))))


# The fields a catalogue entry and its examples must have, with their JSON types (None: checked on its own).
CONCEPT_FIELDS = {"name": "STRING", "prompt": "STRING", "examples": "ARRAY", "category": "STRING", "is_default": "BOOLEAN"}
EXAMPLE_FIELDS = {"text": "STRING", "annotation": None, "explanation": "STRING"}


def _field_issues(value: Column, fields: dict[str, str | None], prefix: Column) -> Column:
    """Array of (field, issue_code) for the fields of a JSON object that are missing or of another type."""

    def issue(name: str, kind: str | None) -> Column:
        found = F.variant_get(value, f"$.{name}", "variant")
        wrong = F.lit(False) if kind is None else ~F.schema_of_variant(found).startswith(kind)
        code = F.when(found.isNull(), "missing_field").when(wrong, "wrong_type")
        return F.struct(F.concat(prefix, F.lit(name)).alias("field"), code.alias("issue_code"))

    return F.filter(F.array(*[issue(n, k) for n, k in fields.items()]), lambda x: x["issue_code"].isNotNull())


def _example_issues(example: Column, index: Column) -> Column:
    prefix = F.concat(F.lit("examples["), index.cast("string"), F.lit("]."))
    note = F.variant_get(example, "$.annotation", "variant")
    kind = F.schema_of_variant(note)
    markup = markup_issue(F.try_variant_get(example, "$.annotation", "string"))
    annotation = F.when(kind == "STRING", F.when(markup.isNotNull(), "invalid_markup")).when(kind.startswith("OBJECT"), F.when(doc_issue(note).isNotNull(), "invalid_document")).when(note.isNotNull(), "wrong_type")
    blank = strip(F.try_variant_get(example, "$.explanation", "string")) == ""
    own = F.array(
        F.struct(F.concat(prefix, F.lit("annotation")).alias("field"), annotation.alias("issue_code")),
        F.struct(F.concat(prefix, F.lit("explanation")).alias("field"), F.when(blank, "blank").alias("issue_code")),
    )
    return F.concat(_field_issues(example, EXAMPLE_FIELDS, prefix), F.filter(own, lambda x: x["issue_code"].isNotNull()))


def validate_catalog(concepts: DataFrame, key: str = "id", payload: str = "payload") -> DataFrame:
    """(key, field, issue_code): what is wrong with the JSON of each catalogue entry, all of it, without a shuffle."""
    rows = concepts.select(key, F.try_parse_json(payload).alias("v"))
    whole = lambda field, code: F.array(F.struct(F.lit(field).alias("field"), F.lit(code).alias("issue_code")))
    examples = F.coalesce(F.try_variant_get("v", "$.examples", "array<variant>"), F.array().cast("array<variant>"))
    inside = F.concat(_field_issues(F.col("v"), CONCEPT_FIELDS, F.lit("")), F.flatten(F.transform(examples, _example_issues)))
    issues = F.when(F.col("v").isNull(), whole("", "invalid_json")).when(~F.schema_of_variant("v").startswith("OBJECT"), whole("", "not_an_object")).otherwise(inside)
    return rows.select(key, F.explode(issues).alias("i")).select(key, "i.field", "i.issue_code")


def verify_responses(df: DataFrame, rules: list[tuple[str, list[str]]], sample_text: str = "sample_text") -> DataFrame:
    """Issue rows (all input columns, code, severity, detail) for parsed responses with text, annotation, explanation and ``warning``.

    A response that could not be parsed, or whose markup is invalid, stops there; other checks add up.
    """
    text, annotation = F.col("text"), F.col("annotation")
    row = lambda code, sev, detail: F.struct(F.lit(code).alias("code"), F.lit(sev).alias("severity"), detail.alias("detail"))
    issue_type = "array<struct<code:string,severity:string,detail:string>>"
    none = F.array().cast(issue_type)
    one = lambda cond, r: F.when(cond, F.array(r)).otherwise(none)
    mismatch = one(~text.eqNullSafe(F.col(sample_text)), row("text_mismatch", "warning", F.lit("")))

    def checks(tokens: Column) -> Column:
        labels = F.array_distinct(F.transform(tokens, lambda t: t["label"]))
        lost = F.filter(tokens, lambda t: ~t["implicit"] & ~F.contains(F.col(sample_text), t["text"]))
        found = [
            F.transform(lost, lambda t: row("span_not_found", "error", t["text"])),
            one(strip(F.coalesce("explanation", F.lit(""))) == "", row("missing_explanation", "error", F.lit(""))),
        ]
        for name, need in rules:
            hit = F.size(F.array_except(F.array(*[F.lit(x) for x in need]), labels)) == 0
            found.append(one(hit, row("logic_conflict", "error", F.lit(name))))
        return F.concat(*found)

    bad = markup_issue(annotation)
    issues = F.when(text.isNull() & annotation.isNull(), F.array(row("invalid_json", "error", F.lit("")))).otherwise(
        F.concat(
            mismatch,
            let(bad, lambda b: F.when(b.isNotNull(), F.array(row("invalid_annotation", "error", b))).otherwise(let(parse_markup(annotation), checks))),
        )
    )
    return df.select("*", F.explode(issues).alias("i_")).select(*df.columns, "i_.code", "i_.severity", "i_.detail")


def gold_format_issues(tasks: DataFrame, labels: list[str]) -> DataFrame:
    """(task_id, span_index, issue_code) of gold tasks against a frozen label set."""
    row = lambda i, code: F.struct(i.cast("int").alias("span_index"), F.lit(code).alias("issue_code"))
    issue_type = "array<struct<span_index:int,issue_code:string>>"
    none = F.array().cast(issue_type)
    text = F.coalesce(F.col("text"), F.lit(""))

    def of_span(s: Column, i: Column) -> Column:
        word, label = F.coalesce(s["text"], F.lit("")), F.coalesce(s["label"], F.lit(""))
        return F.concat(
            F.when(word == "", F.array(row(i, "empty_span"))).otherwise(none),
            F.when((label != "") & ~label.isin(labels), F.array(row(i, "unknown_label"))).otherwise(none),
            F.when((word != "") & ~s["implicit"] & ~F.contains(text, word), F.array(row(i, "span_not_in_text"))).otherwise(none),
        )

    issues = F.concat(F.when(strip(text) == "", F.array(row(F.lit(-1), "empty_text"))).otherwise(none), F.flatten(F.transform("spans", of_span)))
    return tasks.select(F.col("id").alias("task_id"), F.explode(issues).alias("i")).select("task_id", "i.span_index", "i.issue_code")


def gold_format_check(tasks: DataFrame, labels: list[str]) -> DataFrame:
    """One row: number of gold tasks checked, number of issues, status."""
    checked = tasks.agg(F.count(F.lit(1)).alias("checked_gold_count"))
    found = gold_format_issues(tasks, labels).agg(F.count(F.lit(1)).alias("issue_count"))
    both = one_row(checked, found)
    return both.withColumn("status", F.when(F.col("issue_count") == 0, "passed").otherwise("failed"))


EXPORT_KINDS = {
    "all": lambda: F.lit(True),
    "confirmed": lambda: F.col("answer") == "accept",
    "auto": lambda: F.col("route") == "auto_accept",
    "reviewed": lambda: F.col("reviewed"),
    "hard": lambda: F.col("hard_example"),
    "low_confidence": lambda: F.col("route") == "review",
}


def export_filter(tasks: DataFrame, kind: str) -> DataFrame:
    if kind not in EXPORT_KINDS:
        raise ValueError(f"unknown export kind: {kind}")
    return tasks.where(EXPORT_KINDS[kind]())


def export_kinds(tasks: DataFrame) -> DataFrame:
    """A row for each task and each export filter that keeps it, in one pass."""
    kinds = F.filter(F.array(*[F.when(test(), name) for name, test in EXPORT_KINDS.items()]), lambda k: k.isNotNull())
    return tasks.withColumn("export_kind", F.explode(kinds))


def project_score_filter(tasks: DataFrame, project: str | None = None, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Tasks of one project (``None``: those without one count as their own bucket) with a score in range; no score counts as 0."""
    out = tasks.where(F.coalesce(F.col("score"), F.lit(0.0)).between(low, high))
    return out if project is None else out.where(F.coalesce(F.col("project_id"), F.lit("unassigned")) == project)


def event_filter(events: DataFrame, event_type: str | None = None, stage: str | None = None, keyword: str | None = None, in_columns: tuple = ("message", "payload")) -> DataFrame:
    out = events
    if event_type:
        out = out.where(F.col("event_type") == event_type)
    if stage:
        out = out.where(F.col("stage") == stage)
    if keyword:
        hits = [F.contains(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(keyword.lower())) for c in in_columns]
        cond = hits[0]
        for h in hits[1:]:
            cond = cond | h
        out = out.where(cond)
    return out


def judge_items(
    items: DataFrame, language: str, domain: str, banned: list[str], min_prompt: int = 8, min_response: int = 40,
    require_terms: bool = True, max_similarity: float = 0.92,
) -> DataFrame:
    """Adds ``issues`` and ``status`` to items with prompt, response, language, domain, source_chunk_ids, allowed_ids, term_pack.

    A ``similarity`` column, where present, is judged too.
    """
    prompt, response = strip(F.coalesce("prompt", F.lit(""))), strip(F.coalesce("response", F.lit("")))
    body = F.concat(prompt, F.lit("\n"), response)
    ids = F.coalesce("source_chunk_ids", F.array().cast("array<string>"))
    hit = F.lit(None).cast("string")
    for term in reversed([b for b in banned if b]):
        hit = F.when(F.contains(body, F.lit(term)), term).otherwise(hit)
    checks = [
        F.when(prompt == "", "missing_prompt").when(F.length(prompt) < min_prompt, "short_prompt"),
        F.when(response == "", "missing_response").when(F.length(response) < min_response, "short_response"),
        F.when(strip(F.coalesce("language", F.lit(""))) != language, "language_mismatch"),
        F.when(strip(F.coalesce("domain", F.lit(""))) != domain, "domain_mismatch"),
        F.when(F.size(ids) == 0, "missing_lineage").when(F.size(F.array_except(ids, "allowed_ids")) > 0, "invalid_source"),
        F.when(hit.isNotNull(), F.concat(F.lit("banned_term:"), hit)),
    ]
    if require_terms:
        checks.append(F.when((F.size("term_pack") > 0) & ~F.exists("term_pack", lambda t: F.contains(body, t)), "weak_grounding"))
    if "similarity" in items.columns:
        checks.append(F.when(F.col("similarity") >= max_similarity, "duplicate"))
    judged = items.withColumn("issues", F.array_compact(F.array(*checks)))
    return judged.withColumn("status", F.when(F.size("issues") == 0, "accepted").otherwise("review"))


def preview(tasks: DataFrame, limit: int = 5) -> DataFrame:
    return tasks.select("id", "text", F.size("tokens").alias("token_count"), "meta").orderBy("id").limit(limit)
