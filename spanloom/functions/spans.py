"""Span keys, overlap measures and edge handling over span arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import SPAN_DDL
from .core import half_even, let

# Fields that identify a span, per profile. Keys are strings so that set functions can hash them.
PROFILES = {
    "metric": ("start", "end", "label"),
    "consistency": ("start", "end", "text", "label", "implicit"),
    "batch": ("start", "end", "text", "label"),
    "gold": ("start", "end", "text", "label", "implicit"),
}
FIELD_SEP = "\x1f"
KEY_SEP = "\x1e"


def _plain(field: Column) -> Column:
    """A field without separators of its own; NULL differs from every text."""
    value = F.replace(field.cast("string"), F.lit("\x1d"), F.lit("\x1d0"))
    value = F.replace(F.replace(value, F.lit(KEY_SEP), F.lit("\x1d1")), F.lit(FIELD_SEP), F.lit("\x1d2"))
    return F.coalesce(value, F.lit("\x1dn"))


def span_key(span: Column, profile: str) -> Column:
    free = {"text", "label"}
    return F.concat_ws(FIELD_SEP, *[_plain(span[f]) if f in free else F.coalesce(span[f].cast("string"), F.lit("\x1dn")) for f in PROFILES[profile]])


def span_keys(spans: Column, profile: str) -> Column:
    return F.array_distinct(F.transform(spans, lambda s: span_key(s, profile)))


def signature(spans: Column, profile: str) -> Column:
    """One string per distinct span set: sorted keys, joined."""
    return F.array_join(F.sort_array(span_keys(spans, profile)), KEY_SEP)  # keys are never NULL


def signature_keys(sig: Column) -> Column:
    return F.when(sig == "", F.array().cast("array<string>")).otherwise(F.split(sig, KEY_SEP))


def _ratio(num: Column, den: Column) -> Column:
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def f1_from_counts(tp: Column, n_left: Column, n_right: Column, profile: str) -> Column:
    """Span F1 in the arithmetic of the profile; 'consistency' and 'metric' round to four places."""
    both_empty = (n_left == 0) & (n_right == 0)
    if profile == "gold":
        return F.when(both_empty, 1.0).when((n_left == 0) | (n_right == 0), 0.0).otherwise(F.lit(2.0) * tp / (n_left + n_right))
    p, r = _ratio(tp, n_left), _ratio(tp, n_right)
    f1 = F.when(p + r == 0, 0.0).otherwise(F.lit(2.0) * p * r / (p + r))
    if profile == "metric":
        return half_even(f1, 4)
    value = F.when(both_empty, 1.0).when((n_left == 0) | (n_right == 0), 0.0)
    return value.otherwise(half_even(f1, 4) if profile == "consistency" else f1)


def span_f1(left: Column, right: Column, profile: str) -> Column:
    """F1 of two span arrays."""
    return key_f1(span_keys(left, profile), span_keys(right, profile), profile)


def key_f1(left_keys: Column, right_keys: Column, profile: str) -> Column:
    """F1 of two arrays of distinct keys. The formula names each count many times: keys and counts are bound, so they are made once."""

    def counted(k: Column) -> Column:
        return F.struct(F.size(F.array_intersect(k["a"], k["b"])).alias("tp"), F.size(k["a"]).alias("a"), F.size(k["b"]).alias("b"))

    keys = F.struct(left_keys.alias("a"), right_keys.alias("b"))
    return let(let(keys, counted), lambda n: f1_from_counts(n["tp"], n["a"], n["b"], profile))


def rule_risk(spans: Column, text: Column, warning: Column | None = None) -> Column:
    """1 with a parse warning, else the share of explicit spans that do not match the text."""

    def invalid(s: Column) -> Column:
        return ~s["implicit"] & (
            (s["start"] < 0) | (s["end"] > F.length(text)) | (F.substring(text, s["start"] + 1, s["end"] - s["start"]) != s["text"])
        )

    bad = F.size(F.filter(spans, invalid))
    share = F.least(F.lit(1.0), bad / F.greatest(F.size(spans), F.lit(1)))
    return share if warning is None else F.when(F.coalesce(warning, F.lit("")) != "", 1.0).otherwise(share)


def missing_keys(gold: Column, pred: Column) -> Column:
    return F.array_sort(F.array_except(span_keys(gold, "gold"), span_keys(pred, "gold")))


def extra_keys(gold: Column, pred: Column) -> Column:
    return F.array_sort(F.array_except(span_keys(pred, "gold"), span_keys(gold, "gold")))


def span_difference(left: Column, right: Column) -> Column:
    """Spans of ``left`` whose key is not in ``right``, distinct, ordered by (start, end, text, label, implicit)."""
    fields = lambda spans: F.transform(spans, lambda s: F.struct(*[s[f].alias(f) for f in PROFILES["gold"]]))
    return F.array_sort(F.array_except(fields(left), fields(right)))


def empty_spans() -> Column:
    return F.array().cast(f"array<{SPAN_DDL}>")
