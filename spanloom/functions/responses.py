"""Model responses: fences, lenient JSON, required fields, confidence, redaction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import SPAN_DDL
from .core import let, strip
from .core import half_even
from .markup import markup_issue, markup_to_spans
from .spans import empty_spans

SPAN_FIELDS = ["id", "start", "end", "text", "label", "implicit"]


def strip_code_fence(raw: Column) -> Column:
    opened = F.regexp_replace(strip(raw), "^```json", "")
    return strip(F.regexp_replace(F.regexp_replace(opened, "^```", ""), "```$", ""))


def doc_issue(doc: Column) -> Column:
    """NULL for a valid annotation document (a VARIANT), else the first rule it breaks."""
    has = lambda v, path: F.variant_get(v, path, "variant").isNotNull()
    spans = F.try_variant_get(doc, "$.layers.spans", "array<variant>")
    kind = lambda path: F.schema_of_variant(F.variant_get(doc, path, "variant"))

    def span_bad(s: Column) -> Column:
        bad = ~F.schema_of_variant(s).startswith("OBJECT")
        for f in SPAN_FIELDS:
            bad = bad | ~has(s, f"$.{f}")
        return bad

    return (
        F.when(~F.schema_of_variant(doc).startswith("OBJECT"), "not_an_object")
        .when(~(has(doc, "$.version") & has(doc, "$.text") & has(doc, "$.layers")), "missing_field")
        .when(~kind("$.layers").startswith("OBJECT"), "layers_not_an_object")
        .when(~has(doc, "$.layers.spans") | ~kind("$.layers.spans").startswith("ARRAY"), "spans_not_a_list")
        .when(F.exists(spans, span_bad), "span_missing_field")
    )


def parse_response(raw: Column) -> Column:
    """struct<text, explanation, annotation, spans, warning>; ``warning`` is NULL when the response is usable."""
    out_type = f"struct<text:string,explanation:string,annotation:string,spans:array<{SPAN_DDL}>,warning:string>"

    def from_variant(v: Column) -> Column:
        part = lambda name: F.variant_get(v, f"$.{name}", "variant")
        text = F.try_variant_get(v, "$.text", "string")
        explanation = F.try_variant_get(v, "$.explanation", "string")
        annotation = part("annotation")
        is_doc = F.coalesce(F.schema_of_variant(annotation).startswith("OBJECT"), F.lit(False))
        markup = F.coalesce(F.try_variant_get(v, "$.annotation", "string"), F.lit(""))
        is_text = F.coalesce(F.schema_of_variant(part("explanation")) == "STRING", F.lit(False))
        issue = F.when(is_doc, doc_issue(annotation)).otherwise(F.when(strip(markup) != "", markup_issue(markup)))
        warning = (
            F.when(v.isNull(), "invalid_json")
            .when(part("text").isNull() | annotation.isNull() | part("explanation").isNull(), "missing_fields")
            .when(~is_text | (strip(explanation) == ""), "blank_explanation")
            .when(is_doc & issue.isNotNull(), F.concat(F.lit("doc_"), issue))
            .when(is_doc & ~F.try_variant_get(annotation, "$.text", "string").eqNullSafe(text), "doc_text_mismatch")
            .when(~is_doc & issue.isNotNull(), F.concat(F.lit("markup_"), issue))
        )

        def build(w: Column) -> Column:
            spans = (
                F.when(w.isNotNull(), empty_spans())
                .when(is_doc, F.try_variant_get(annotation, "$.layers.spans", f"array<{SPAN_DDL}>"))
                .otherwise(markup_to_spans(text, markup))
            )
            return F.struct(
                text.alias("text"), explanation.alias("explanation"),
                F.when(~is_doc, markup).alias("annotation"), spans.alias("spans"), w.alias("warning"),
            ).cast(out_type)

        return let(warning, build)

    return let(F.try_parse_json(strip_code_fence(raw)), from_variant)


def confidence_of(raw: Column, default: Column | float) -> Column:
    """``confidence``, else ``model_confidence``, else the default; clamped to [0, 1] and rounded to four places."""
    default = F.lit(default) if isinstance(default, (int, float)) else default

    def read(v: Column) -> Column:
        field = lambda name: F.variant_get(v, f"$.{name}", "variant")
        value = F.when(field("confidence").isNotNull(), F.try_variant_get(v, "$.confidence", "double")).when(
            field("model_confidence").isNotNull(), F.try_variant_get(v, "$.model_confidence", "double")
        )
        return half_even(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(value, default.cast("double")))), 4)

    return let(F.try_parse_json(strip_code_fence(raw)), read)


# Payload keys that never leave the progress log.
REDACTED_KEYS = [
    "annotation", "best_description", "candidate_description", "content", "current_description", "description", "extra_spans", "forbidden",
    "gold_spans", "leaked_terms", "messages", "missing_spans", "predicted_spans", "private_matches", "prompt", "raw_prompt", "raw_response",
    "raw_revision_response", "response", "source_text", "text",
]
REDACTED = "[redacted]"
TOO_DEEP = "[redacted: nested payload]"


def redact(col: Column, dtype: T.DataType, depth: int = 0) -> Column:
    """Mask sensitive keys, shorten long strings and lists; walks the type once and emits one expression."""
    if depth > 5:
        return F.lit(TOO_DEEP)
    if isinstance(dtype, T.StructType):
        fields = [
            (F.lit(REDACTED) if f.name in REDACTED_KEYS or f.name.lower() in REDACTED_KEYS else redact(col[f.name], f.dataType, depth + 1)).alias(f.name)
            for f in dtype.fields
        ]
        return F.when(col.isNotNull(), F.struct(*fields))
    if isinstance(dtype, T.MapType):
        def value(k: Column, v: Column) -> Column:
            safe = redact(v, dtype.valueType, depth + 1)
            return F.when(k.isin(REDACTED_KEYS) | F.lower(k).isin(REDACTED_KEYS), F.lit(REDACTED)).otherwise(safe)

        if not isinstance(dtype.valueType, T.StringType):
            raise TypeError("a map needs string values: a masked value is a string")
        return F.transform_values(col, value)
    if isinstance(dtype, T.ArrayType):
        return F.transform(F.slice(col, 1, 100), lambda x: redact(x, dtype.elementType, depth + 1))
    if isinstance(dtype, T.StringType):
        return F.when(F.length(col) <= 500, col).otherwise(F.concat(F.substring(col, 1, 500), F.lit("...")))
    return col
