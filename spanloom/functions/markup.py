"""Inline markup ``[text]{Label}`` / ``[!implied]{Label}`` and annotation documents."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import DOC_VERSION
from .core import SPACE_CLASS, chunked_scan, let, strip

# The markup pattern and the superseded form that is refused.
MARKUP = r"\[([^\[\]]+)\]\{([^{}]+)\}"
OLD_MARKUP = rf"\[[^\[\]]+\][{SPACE_CLASS}]*\([^)]+\)"


def parse_markup(markup: Column) -> Column:
    """array<struct<text, label, implicit>> in order of appearance."""
    raw = F.regexp_extract_all(markup, F.lit(MARKUP), F.lit(1))
    labels = F.regexp_extract_all(markup, F.lit(MARKUP), F.lit(2))

    def item(r: Column, lab: Column) -> Column:
        implicit = r.startswith("!")
        text = F.when(implicit, strip(F.substring(r, 2, 2147483647))).otherwise(r)
        return F.struct(text.alias("text"), strip(lab).alias("label"), implicit.alias("implicit"))

    return F.zip_with(F.transform(raw, strip), labels, item)


def markup_to_spans(text: Column, markup: Column) -> Column:
    """Place each marked text left to right; the search position moves only on a hit, misses and implied spans get -1.

    A search counts its way from the front of what it searches, so each block of marks searches only the text from its own position on.
    """

    def place(source: Column) -> Column:
        rest = lambda pos: F.struct(pos.alias("pos"), F.substring(source, pos + 1, F.lit(2147483647)).alias("text"))

        def step(pos: Column, item: Column, seen: Column) -> Column:
            at = item["text"]
            here = let(F.position(at, seen["text"], pos - seen["pos"] + 1), lambda f: F.when(f > 0, f + seen["pos"]).otherwise(f))
            found = F.when(item["implicit"], F.lit(0)).when(at == "", pos + 1).otherwise(here)
            return let(found, lambda f: F.struct(F.when(f > 0, f - 1 + F.length(at)).otherwise(pos).alias("pos"), f.alias("out")))

        def placed(items: Column) -> Column:
            # The scan carries places alone: what it has so far is copied at every step.
            found = chunked_scan(items, F.lit(0), step, "int", block=32, enter=rest)
            return F.transform(F.zip_with(items, found, lambda m, f: F.struct(m.alias("m"), f.alias("f"))), span)

        def span(x: Column, i: Column) -> Column:
            m, f = x["m"], x["f"]
            return F.struct(
                F.concat(F.lit("s"), i.cast("string")).alias("id"),
                F.when(f > 0, f - 1).otherwise(F.lit(-1)).alias("start"),
                F.when(f > 0, f - 1 + F.length(m["text"])).otherwise(F.lit(-1)).alias("end"),
                m["text"].alias("text"), m["label"].alias("label"), m["implicit"].alias("implicit"),
            )

        none = F.array().cast("array<struct<text:string,label:string,implicit:boolean>>")
        return let(F.coalesce(parse_markup(markup), none), placed)  # no markup: no spans

    return let(text, place)


def spans_to_markup(spans: Column) -> Column:
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat(F.lit("["), F.when(s["implicit"], "!").otherwise(""), s["text"], F.lit("]{"), s["label"], F.lit("}")),
        ),
        " ",
    )


def first_places(text: pa.Array, words: pa.Array) -> pa.Array:
    """Where each word first occurs in its text, from 1; 0 where it does not, NULL without a text or a word."""
    ends, flat = words.offsets.to_pylist(), words.values.to_pylist()
    last, places, out = None, {}, []
    for i in range(len(words)):
        if ends[i] == ends[i + 1]:
            continue
        source, asked = text[i].as_py(), flat[ends[i] : ends[i + 1]]
        if source is None:
            out += [None] * len(asked)
            continue
        if source != last:  # candidates of a sample follow each other, and most of their words are the same
            last, places = source, {None: None}
        for word in asked:
            if word not in places:
                places[word] = source.find(word) + 1
        out += map(places.__getitem__, asked)
    offsets = pa.array(np.array(ends, np.int32) - ends[0], mask=np.append(words.is_null().to_numpy(zero_copy_only=False), False))
    return pa.ListArray.from_arrays(offsets, pa.array(out, pa.int32()))


def relocate_spans(spans: Column, text: Column) -> Column:
    """First occurrence of every explicit span (no moving cursor); explicit spans that cannot be placed are dropped.

    ``spans`` and ``text`` are columns, not variables of a lambda. The search counts as one that may not be moved or repeated: else a condition that
    the planner derives from the result takes it along, and no Python function can stand there.
    """
    asked = F.transform(spans, lambda s: F.when(s["implicit"], F.lit(None)).otherwise(s["text"]))
    places = F.arrow_udf(first_places, "array<int>").asNondeterministic()(text, asked)

    def move(x: Column, i: Column) -> Column:
        s = x["span"]
        found = F.when(s["implicit"], F.lit(0)).otherwise(x["at"])
        start = F.when(s["implicit"], -1).when(found > 0, found - 1).otherwise(s["start"])
        end = F.when(s["implicit"], -1).when(found > 0, found - 1 + F.length(s["text"])).otherwise(s["end"])
        return F.struct(
            F.coalesce(F.nullif(s["id"], F.lit("")), F.concat(F.lit("T"), (i + 1).cast("string"))).alias("id"),
            start.alias("start"), end.alias("end"), s["text"].alias("text"), s["label"].alias("label"), s["implicit"].alias("implicit"),
        )

    both = F.zip_with(spans, places, lambda s, at: F.struct(s.alias("span"), at.alias("at")))
    return F.filter(F.transform(both, move), lambda s: s["implicit"] | (s["start"] >= 0))


def annotation_doc(text: Column, spans: Column) -> Column:
    """The annotation document as a struct; ``to_json`` gives its file form."""
    none = F.array().cast("array<string>")
    return F.struct(
        F.lit(DOC_VERSION).alias("version"), text.alias("text"),
        F.struct(
            spans.alias("spans"), none.alias("relations"), none.alias("attributes"), none.alias("comments"), none.alias("document_labels"),
        ).alias("layers"),
        F.create_map().cast("map<string,string>").alias("provenance"), F.create_map().cast("map<string,string>").alias("meta"),
    )


def markup_issue(markup: Column) -> Column:
    """NULL for valid markup, else the first rule it breaks."""

    def judge(tokens: Column) -> Column:
        # The first offending item decides, and a missing label is judged before a missing text.
        bad = F.filter(tokens, lambda t: (t["label"] == "") | (t["text"] == ""))
        first = F.get(bad, F.lit(0))
        return (
            F.when(F.size(tokens) == 0, "no_span")
            .when(F.size(bad) == 0, F.lit(None).cast("string"))
            .when(first["label"] == "", "empty_label")
            .when(first["implicit"], "empty_implied")
            .otherwise("empty_text")
        )

    return (
        F.when(markup.isNull() | (strip(markup) == ""), "blank")
        .when(markup.rlike(OLD_MARKUP), "old_format")
        .otherwise(let(parse_markup(markup), judge))
    )
