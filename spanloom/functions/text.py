"""Sentences, tokens and other whole-text expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import SPACE_CLASS, collapse, let, lines, rstrip, running_total, strip

# Sentence ends, word characters, the CJK block.
SENTENCE = r"[^。！？!?；;\.\n]+[。！？!?；;\.]?"
STRONG_END = "。！？!?；;"
CJK = r"一-鿿"
WORD = r"A-Za-z0-9_"


def split_sentences(text: Column) -> Column:
    """Sentences of each line; a line with no sentence match is kept whole."""
    kept = F.filter(F.transform(lines(text), strip), lambda x: x != "")

    def of_line(line: Column) -> Column:
        return let(
            F.regexp_extract_all(line, F.lit(SENTENCE), F.lit(0)),
            lambda m: F.when(F.size(m) == 0, F.array(line)).otherwise(F.filter(F.transform(m, strip), lambda x: x != "")),
        )

    return F.flatten(F.transform(kept, of_line))


def _offsets(text: Column, token: str, gap: str, lower: bool) -> Column:
    """Tokens with code-point offsets.

    Two aligned extractions: the tokens, and every token with the gap before it. The running sum of the second's
    lengths is where each token ends, so the text is never searched again.
    """
    tokens = F.regexp_extract_all(text, F.lit(token), F.lit(0))
    reach = F.regexp_extract_all(text, F.lit(f"{gap}(?:{token})"), F.lit(0))
    return _placed(tokens, lambda _: F.transform(reach, F.length), lower)


def _placed(tokens: Column, reach: Callable[[Column], Column], lower: bool) -> Column:
    """Tokens with their places, from how far each reaches beyond the one before."""
    return let(tokens, lambda ts: F.zip_with(
        ts, running_total(reach(ts)),
        lambda t, e: F.struct((F.lower(t) if lower else t).alias("text"), (e - F.length(t)).alias("start"), e.alias("end")),
    ))


def tokenize(text: Column) -> Column:
    """Word runs, single CJK characters and any other visible character, with offsets."""
    return _offsets(text, rf"[{WORD}]+|[{CJK}]|[^{SPACE_CLASS}]", f"[{SPACE_CLASS}]*", lower=False)


def tokenize_words(text: Column, lower: bool = True, least: int = 1) -> Column:
    """Word runs and single CJK characters with offsets; no punctuation.

    With ``least`` above 1 only word runs of that many characters: the others are passed over with the gaps, whose lengths are those
    of the pieces between the runs.
    """
    if least == 1:
        return _offsets(text, rf"[{WORD}]+|[{CJK}]", f"[^{WORD}{CJK}]*", lower=lower)
    run = rf"[{WORD}]{{{least},}}"
    tokens, gaps = F.regexp_extract_all(text, F.lit(run), F.lit(0)), F.split(text, run, -1)
    return _placed(tokens, lambda ts: F.zip_with(ts, F.slice(gaps, 1, F.size(ts)), lambda t, g: F.length(t) + F.length(g)), lower)


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(rf"[a-z0-9_]+|[{CJK}]"), F.lit(0))


def word_set(text: Column) -> Column:
    return F.array_distinct(words(text))


def shorten(text: Column, limit: Column | int) -> Column:
    """Collapse whitespace; longer results are cut to limit-1, right-trimmed and closed with an ellipsis."""
    limit = F.lit(limit) if isinstance(limit, int) else limit
    return let(
        collapse(text),
        lambda c: F.when(F.length(c) <= limit, c).otherwise(F.concat(rstrip(F.substring(c, 1, limit - 1)), F.lit("…"))),
    )


def key_sentences(text: Column, limit: int = 3, max_chars: int = 140) -> Column:
    """The first sentences that end in a strong mark (the ASCII full stop does not count), shortened."""
    parts = F.split(strip(text), f"(?<=[{STRONG_END}])[{SPACE_CLASS}]*")
    kept = F.filter(F.transform(parts, collapse), lambda x: x != "")
    return F.transform(F.slice(kept, 1, limit), lambda s: shorten(s, max_chars))


def dedupe_keep_order(items: Column, limit: int | None = None, ignore_case: bool = False) -> Column:
    """Trimmed, non-empty, first occurrence kept."""
    cleaned = F.filter(F.transform(items, strip), lambda x: x != "")
    if not ignore_case:
        out = F.array_distinct(cleaned)
    else:
        # Sorted by folded text and place, the first of each run of equal ones stays; sorted by place again, they are in their old order.
        folded = F.sort_array(F.transform(cleaned, lambda x, i: F.struct(F.lower(x).alias("key"), i.alias("at"), x.alias("item"))))
        firsts = let(folded, lambda xs: F.filter(xs, lambda x, i: (i == 0) | (x["key"] != F.get(xs, i - 1)["key"])))
        out = F.transform(F.sort_array(F.transform(firsts, lambda x: F.struct(x["at"].alias("at"), x["item"].alias("item")))), lambda x: x["item"])
    return out if limit is None else F.slice(out, 1, limit)


def length_units(text: Column, language: Column) -> Column:
    """Words for English, characters otherwise, of the collapsed text."""
    return let(
        collapse(text),
        lambda c: F.when(c == "", 0)
        .when(F.lower(language).startswith("en"), F.size(F.split(c, " ")))
        .otherwise(F.length(c)),
    )


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4).cast("int"))


# Prefixes and markers of lines that belong to an output protocol, not to a description.
PROTOCOL_PREFIXES = [
    "标签集合", "labels", "label schema", "输出格式", "output format", "runtime annotation format", "json schema",
    "json字段", "json 字段", "annotation", "annotation 格式", "annotation markup", "parser contract", "format repair",
    "frozen outputprotocolspec",
]
PROTOCOL_MARKERS = ["text / annotation / explanation", "text/annotation/explanation", "[span]{", "[原文]{标签}"]
# Lines that report on a failed round, and openings a model puts before its answer.
DIAGNOSTIC_SIGNS = [r"\bgold-[0-9]+\b", "失败摘要", "失败样例", "本轮失败", "修订建议", "漏标", "多标", "边界不稳定样例", "失败/不稳定样例"]
DIAGNOSTIC_LINE = "(?i)" + "|".join(DIAGNOSTIC_SIGNS)
PREFACES = ["以下是", "下面是", "这里是", "已根据", "我已", "好的", "Here is", "Below is", "I have", "Explanation", "Change log"]
DESCRIPTION_HEADS = ["概念描述：", "Concept description:", "Concept Description:"]
SUPPORT_FIELDS = ["标签集合：", "边界规则：", "排除规则：", "输出格式：", "Labels:", "Boundary", "Negative", "Output"]


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def is_protocol_line(line: Column, prefixes: list[str] | None = None) -> Column:
    bare = F.regexp_replace(F.ltrim(F.lower(strip(line)), F.lit("-*0123456789. \t")), "[:：]+$", "")
    return _any([bare.startswith(p) for p in (prefixes or PROTOCOL_PREFIXES)] + [F.contains(bare, F.lit(m)) for m in PROTOCOL_MARKERS])


def _join_squeezed(kept: Column) -> Column:
    """Join lines: inner blank runs shrink to one blank line, none at either end."""
    return strip(F.regexp_replace(F.array_join(kept, "\n"), "\n{3,}", "\n\n"))


def _tidy(line: Column) -> Column:
    return F.when(strip(line) == "", F.lit("")).otherwise(rstrip(line))


def strip_protocol_lines(text: Column, prefixes: list[str] | None = None) -> Column:
    """Drop protocol lines, keep the rest with blank runs squeezed."""
    kept = F.filter(F.transform(lines(text), _tidy), lambda x: (x == "") | ~is_protocol_line(x, prefixes))
    return _join_squeezed(kept)


def sanitize_description(text: Column, fallback: Column) -> Column:
    """Keep only the description part of a revision; fall back when too little is left."""
    raw = strip(text)

    def body(all_lines: Column) -> Column:
        is_head = lambda x: _any([strip(x).startswith(h) for h in DESCRIPTION_HEADS])
        flags = F.transform(all_lines, is_head)
        first = F.array_position(flags, F.lit(True)).cast("int")
        kept = F.when(first > 0, F.slice(all_lines, first, F.size(all_lines))).otherwise(all_lines)

        def clean(ls: Column) -> Column:
            no_diag = F.filter(
                ls,
                lambda x, i: ~((strip(x) != "") & (strip(x).rlike(DIAGNOSTIC_LINE) | ((i <= 2) & _any([strip(x).startswith(p) for p in PREFACES])))),
            )
            dropped = F.exists(ls, lambda x: strip(x).rlike(DIAGNOSTIC_LINE))
            joined = _join_squeezed(F.transform(no_diag, _tidy))
            shaped = _any([F.contains(joined, F.lit(h)) for h in DESCRIPTION_HEADS]) & _any([F.contains(joined, F.lit(s)) for s in SUPPORT_FIELDS])
            return F.when((joined == "") | joined.rlike(DIAGNOSTIC_LINE) | (dropped & ~shaped), strip(fallback)).otherwise(joined)

        return let(kept, clean)

    return F.when(raw == "", strip(fallback)).otherwise(let(lines(raw), body))


# Headings that open a typed segment, as they are written; they are compared without case.
SEGMENT_OPENERS = [
    ("概念描述", "task_definition"),
    ("Concept description", "task_definition"),
    ("Concept Description", "task_definition"),
    ("标签集合", "label_schema"),
    ("Labels", "label_schema"),
    ("Label schema", "label_schema"),
    ("边界规则", "boundary_rules"),
    ("Boundary rules", "boundary_rules"),
    ("排除规则", "negative_rules"),
    ("负例规则", "negative_rules"),
    ("Negative rules", "negative_rules"),
    ("输出格式", "output_format"),
    ("Output format", "output_format"),
    ("边界补充", "boundary_rules"),
    ("Boundary supplement", "boundary_rules"),
]
FROZEN_KINDS = ["output_format", "label_schema"]


def opened_kind(line: Column, headings: list[tuple[str, str]] | None = None) -> Column:
    """The kind of segment a line opens, by the first heading it starts with; NULL for other lines."""
    bare = F.lower(F.regexp_replace(strip(line), "[:：]+$", ""))
    kinds = dict(reversed([(opener.lower(), kind) for opener, kind in headings or SEGMENT_OPENERS]))
    out = F.lit(None).cast("string")
    for opener, kind in kinds.items():  # the last one asked is the first of the list
        out = F.when(bare.startswith(opener), kind).otherwise(out)
    return out


def segment_text(text: Column, headings: list[tuple[str, str]] | None = None) -> Column:
    """array<struct<id, kind, text, index, mutable>>: parts between blank lines and headings; a kind lasts until the next heading."""
    seg = "struct<kind:string,text:string>"
    start = F.struct(
        F.lit("task_definition").alias("kind"), F.array().cast("array<string>").alias("pend"), F.array().cast(f"array<{seg}>").alias("segs")
    )

    def flushed(acc: Column) -> Column:
        done = F.struct(acc["kind"].alias("kind"), strip(F.array_join(acc["pend"], "\n")).alias("text"))
        return F.when(F.size(acc["pend"]) > 0, F.concat(acc["segs"], F.array(done))).otherwise(acc["segs"])

    def step(acc: Column, line: Column) -> Column:
        blank = strip(line) == ""
        kind = opened_kind(line, headings)
        cut = blank | kind.isNotNull()
        empty = F.array().cast("array<string>")
        return F.struct(
            F.when(blank, acc["kind"]).otherwise(F.coalesce(kind, acc["kind"])).alias("kind"),
            F.when(blank, empty).when(cut, F.array(rstrip(line))).otherwise(F.concat(acc["pend"], F.array(rstrip(line)))).alias("pend"),
            F.when(cut, flushed(acc)).otherwise(acc["segs"]).alias("segs"),
        )

    segs = F.aggregate(lines(text), start, step, flushed)
    return F.transform(
        segs,
        lambda s, i: F.struct(
            F.format_string("seg-%02d-%s", i + 1, s["kind"]).alias("id"), s["kind"].alias("kind"), s["text"].alias("text"),
            (i + 1).alias("index"), (~s["kind"].isin(FROZEN_KINDS)).alias("mutable"),
        ),
    )
