"""Readers: text, JSON lines, CSV, samples, candidates and seed documents.

Every reader has two halves. The path half only knows files; the frame half takes lines or rows, so that the same rules
apply to tables that already live in Spark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import markup as mk
from ..functions import text as tx
from ..functions.core import blank_to_null, half_even, strip
from ..functions.spans import empty_spans
from ..schema import CANDIDATE_LINE_DDL, OPTION_DDL, RAW_DOC_DDL, RAW_SPAN_DDL, RELATION_DDL, SAMPLE_LINE_DDL, SEED_LINE_DDL, SPAN_DDL, TASK_DDL
from .positions import with_file_position


def numbered_tokens(text: Column) -> Column:
    return F.transform(tx.tokenize(text), lambda t, i: F.struct(i.alias("id"), t["text"].alias("text"), t["start"].alias("start"), t["end"].alias("end")))


def text_to_tasks(df: DataFrame, *keep: str, text: str = "text", prefix: Column | str = "txt", source: Column | str = "uploaded.txt") -> DataFrame:
    """One task per sentence; ids count sentences within each text."""
    prefix = F.lit(prefix) if isinstance(prefix, str) else prefix
    source = F.lit(source) if isinstance(source, str) else source
    rows = df.select(*keep, prefix.alias("prefix_"), source.alias("source"), F.posexplode(tx.split_sentences(F.col(text))).alias("pos_", "text"))
    return rows.select(
        *keep, F.format_string("%s-%05d", "prefix_", F.col("pos_") + 1).alias("id"), "text", numbered_tokens(F.col("text")).alias("tokens"),
        "source", F.lit("txt").alias("source_format"), (F.col("pos_") + 1).alias("sentence_index"),
    )


def read_text_tasks(spark: SparkSession, path: str, prefix: str = "txt") -> DataFrame:
    """Tasks of one file or a folder of files; with several files the ids carry the file name, so that they stay apart."""
    raw = spark.read.text(path, wholetext=True)
    several = len(raw.inputFiles()) > 1
    rows = raw.select(F.col("value").alias("text"), F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file_"))
    name = F.concat(F.lit(f"{prefix}-"), F.regexp_replace("file_", r"\.[^.]*$", "")) if several else prefix
    return text_to_tasks(rows, text="text", prefix=name, source=F.col("file_"))


def _span(raw: Column, index: Column) -> Column:
    implicit = F.coalesce(raw["implicit"], F.lit(False))
    none = F.when(implicit, -1).otherwise(0)
    return F.struct(
        F.coalesce(F.nullif(raw["id"], F.lit("")), F.concat(F.lit("T"), (index + 1).cast("string"))).alias("id"),
        F.coalesce(raw["start"], raw["begin"], none).alias("start"), F.coalesce(raw["end"], none).alias("end"),
        strip(F.coalesce(raw["text"], F.lit(""))).alias("text"), strip(F.coalesce(raw["label"], F.lit(""))).alias("label"), implicit.alias("implicit"),
    )


def normal_spans(raw_spans: Column) -> Column:
    return F.coalesce(F.transform(raw_spans, _span), empty_spans())


def _empty(ddl: str) -> Column:
    return F.array().cast(f"array<{ddl}>")


def json_to_tasks(df: DataFrame, line: str = "value", position: str = "position", prefix: str = "jsonl", source: Column | str = "uploaded.jsonl") -> DataFrame:
    """Task rows from JSON lines: defaults for missing fields, a positional id where none is given, ``error`` for bad lines."""
    source = F.lit(source) if isinstance(source, str) else source
    parsed = df.where(strip(F.col(line)) != "").select("*", F.from_json(line, f"{TASK_DDL}, _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("r"))
    text = F.col("r.text")
    error = F.when(F.col("r").isNull() | F.col("r._bad").isNotNull(), "invalid_json").when(text.isNull(), "missing_text")
    meta = F.map_concat(
        F.map_filter(F.coalesce(F.col("r.meta"), F.create_map().cast("map<string,string>")), lambda k, v: ~k.isin("source", "source_format")),
        F.create_map(F.lit("source"), source, F.lit("source_format"), F.lit("jsonl")),
    )
    return parsed.select(
        F.coalesce("r.id", F.format_string(f"{prefix}-%05d", F.col(position).cast("long"))).alias("id"), text.alias("text"),
        F.coalesce("r.tokens", numbered_tokens(text)).alias("tokens"), F.coalesce("r.spans", _empty(SPAN_DDL)).alias("spans"),
        F.coalesce("r.relations", _empty(RELATION_DDL)).alias("relations"), F.col("r.label").alias("label"), F.coalesce("r.options", _empty(OPTION_DDL)).alias("options"),
        F.coalesce("r.accept", F.array().cast("array<string>")).alias("accept"), F.col("r.answer").alias("answer"), meta.alias("meta"), error.alias("error"),
    )


def file_name(path: Column) -> Column:
    return F.url_decode(F.element_at(F.split(path, "/"), -1))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their place in the input and the file they come from. The place is the files' own order, so ids are stable between runs."""
    rows = with_file_position(spark.read.text(path))
    return rows.select("value", "position", file_name(F.col("file_")).alias("file"))


def _strict(df: DataFrame, strict: bool) -> DataFrame:
    if strict:
        bad = df.where("error IS NOT NULL").limit(1).collect()
        if bad:
            raise ValueError(f"bad input row: {bad[0].asDict()}")
    return df


def read_jsonl_tasks(spark: SparkSession, path: str, prefix: str = "jsonl", strict: bool = False) -> DataFrame:
    return _strict(json_to_tasks(_lines(spark, path), prefix=prefix, source=F.col("file")), strict)


def rows_to_tasks(df: DataFrame, text_column: str = "text", position: str = "position", prefix: str = "csv", source: Column | str = "uploaded.csv", drop: tuple[str, ...] = ()) -> DataFrame:
    """Task rows from a table with a text column; blank texts are dropped, all other columns (but ``drop``) go to ``meta``."""
    source = F.lit(source) if isinstance(source, str) else source
    if text_column not in df.columns:
        raise ValueError(f"no text column {text_column!r}")
    text = strip(F.coalesce(F.col(text_column).cast("string"), F.lit("")))
    others = [c for c in df.columns if c not in (text_column, position, *drop)]
    pairs = [x for c in others for x in (F.lit(c), F.col(f"`{c}`").cast("string"))]
    place = F.col(position).cast("string")
    meta = F.create_map(*pairs, F.lit("source"), source, F.lit("source_format"), F.lit("csv"), F.lit("row_index"), place)
    return df.where(text != "").select(
        F.format_string(f"{prefix}-%05d", F.col(position).cast("long")).alias("id"), text.alias("text"), numbered_tokens(text).alias("tokens"), meta.alias("meta"),
    )


def read_csv_tasks(spark: SparkSession, path: str, text_column: str = "text", prefix: str = "csv") -> DataFrame:
    rows = with_file_position(spark.read.csv(path, header=True, multiLine=True, escape='"'))
    return rows_to_tasks(rows, text_column, prefix=prefix, source=file_name(F.col("file_")), drop=("file_",))


def read_tasks(spark: SparkSession, path: str, text_column: str | None = None) -> DataFrame:
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind == "txt":
        return read_text_tasks(spark, path)
    if kind == "jsonl":
        return read_jsonl_tasks(spark, path)
    if kind == "csv":
        return read_csv_tasks(spark, path, text_column or "text")
    raise ValueError(f"unsupported file type: {path}")


def gold_rows(df: DataFrame, line: str = "value") -> DataFrame:
    """Gold rows of either form on one input: markup in ``annotation`` or spans in ``spans``; ``gold_format`` says which."""
    r = F.from_json(line, SAMPLE_LINE_DDL)
    rows = df.select("*", r.alias("r"))
    markup = F.col("r.annotation")
    return rows.select(
        *df.columns, strip(F.col("r.text")).alias("text"),
        F.when(markup.isNotNull(), "markup").when(F.col("r.spans").isNotNull(), "spans").otherwise("plain").alias("gold_format"),
        F.when(markup.isNotNull(), mk.markup_to_spans(strip(F.col("r.text")), markup)).otherwise(normal_spans(F.col("r.spans"))).alias("spans"),
    ).drop(line)


def _doc_spans(annotation: Column) -> Column:
    return F.from_json(annotation, RAW_DOC_DDL)["layers"]["spans"]


def json_to_samples(df: DataFrame, line: str = "value", position: str = "position") -> DataFrame:
    """Samples from JSON lines. Spans come from ``spans``, from markup in ``gold_annotation`` or from a document in ``annotation``."""
    rows = df.where(strip(F.col(line)) != "").select(
        "*", F.from_json(line, f"{SAMPLE_LINE_DDL}, _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("r")
    )
    text = strip(F.coalesce(F.col("r.text"), F.lit("")))
    spans = (
        F.when(F.col("r.spans").isNotNull(), normal_spans(F.col("r.spans")))
        .when(F.col("r.gold_annotation").isNotNull(), mk.markup_to_spans(text, F.col("r.gold_annotation")))
        .when(F.col("r.annotation").startswith("{"), normal_spans(_doc_spans(F.col("r.annotation"))))
        .otherwise(empty_spans())
    )
    error = F.when(F.col("r").isNull() | F.col("r._bad").isNotNull(), "invalid_json").when(text == "", "empty_text")
    return rows.select(
        strip(F.coalesce(F.nullif("r.id", F.lit("")), F.format_string("sample-%04d", F.col(position).cast("long")))).alias("id"), text.alias("text"), spans.alias("spans"),
        F.coalesce("r.meta", "r.metadata", F.create_map().cast("map<string,string>")).alias("meta"), error.alias("error"),
    )


def json_to_candidates(df: DataFrame, line: str = "value", position: str = "position") -> DataFrame:
    """Candidates from JSON lines with their alias fields; markup and spans fill each other in."""
    rows = df.where(strip(F.col(line)) != "").select(
        "*", F.from_json(line, f"{CANDIDATE_LINE_DDL}, _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("r")
    )
    text = strip(F.coalesce("r.text", "r.source_text", F.lit("")))
    is_doc = F.coalesce(F.col("r.annotation").startswith("{"), F.lit(False))
    given = strip(F.coalesce("r.annotation_markup", F.nullif("r.runtime_annotation.annotation_markup", F.lit("")), "r.annotation_markup_legacy", F.lit("")))
    markup = F.when((given == "") & F.col("r.annotation").isNotNull() & ~is_doc, strip(F.col("r.annotation"))).otherwise(given)
    raw_spans = F.coalesce(F.col("r.spans"), F.when(is_doc, _doc_spans(F.col("r.annotation"))))
    rows = rows.select("*", text.alias("t_"), markup.alias("m_"), raw_spans.alias("s_"))
    spans = (
        F.when(F.col("s_").isNull() & (F.col("m_") != "") & (F.col("t_") != ""), mk.markup_to_spans(F.col("t_"), F.col("m_")))
        .when(F.col("s_").isNotNull() & (F.col("t_") != ""), normal_spans(F.col("s_")))
        .otherwise(empty_spans())
    )
    conf = F.col("r.model_confidence").try_cast("double")
    error = (
        F.when(F.col("r").isNull() | F.col("r._bad").isNotNull(), "invalid_json")
        .when(strip(F.coalesce("r.sample_id", F.lit(""))) == "", "empty_sample_id")
        .when(F.col("r.model_confidence").isNotNull() & (conf.isNull() | ~conf.between(0, 1)), "bad_confidence")
    )
    rows = rows.select("*", spans.alias("sp_"), conf.alias("c_"), error.alias("error"))
    return rows.select(
        strip(F.col("r.sample_id")).alias("sample_id"),
        strip(F.coalesce(F.nullif("r.candidate_id", F.lit("")), F.nullif("r.run_id", F.lit("")), F.format_string("candidate-%03d", F.col(position).cast("long")))).alias("candidate_id"),
        F.col(position).cast("long").alias("run"), F.col("t_").alias("text"),
        F.when((F.col("m_") == "") & (F.size("sp_") > 0), mk.spans_to_markup(F.col("sp_"))).otherwise(F.col("m_")).alias("annotation_markup"),
        F.col("sp_").alias("spans"), strip(F.coalesce("r.explanation", F.lit(""))).alias("explanation"),
        half_even(F.col("c_"), 4).alias("model_confidence"), strip(F.coalesce("r.uncertainty_reason", F.lit(""))).alias("uncertainty_reason"),
        F.coalesce("r.raw_response", F.lit("")).alias("raw_response"), F.coalesce("r.meta", "r.metadata", F.create_map().cast("map<string,string>")).alias("meta"), "error",
    )


def read_samples(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    return _strict(json_to_samples(_lines(spark, path)), strict)


def read_candidates(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    return _strict(json_to_candidates(_lines(spark, path)), strict)


def seed_rows(df: DataFrame, position: str = "position") -> DataFrame:
    """Seed documents with trimmed fields and defaults; ``error`` marks rows the rules refuse."""
    text = F.coalesce(strip(F.col("text")), F.lit(""))
    doc_id = F.coalesce(blank_to_null(F.col("id")), F.format_string("seed-%04d", F.col(position).cast("long")))
    tags = F.coalesce("tags", F.array().cast("array<string>"))
    default = lambda c, v: F.coalesce(blank_to_null(F.col(c)), F.lit(v))
    error = F.when(text == "", "empty_text").when(F.exists(tags, lambda t: t.isNull() | (strip(t) == "")), "bad_tags")
    return df.select(
        doc_id.alias("doc_id"), F.coalesce(blank_to_null(F.col("title")), doc_id).alias("title"), text.alias("text"),
        default("source_type", "reference").alias("source_type"), default("language", "unknown").alias("language"),
        default("domain", "general").alias("domain"), F.transform(tags, strip).alias("tags"),
        F.coalesce("metadata", F.create_map().cast("map<string,string>")).alias("metadata"), error.alias("error"),
    )


def read_seed_documents(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    rows = _lines(spark, path).where(strip(F.col("value")) != "").select("position", F.from_json("value", SEED_LINE_DDL).alias("r"))
    return _strict(seed_rows(rows.select("position", "r.*")), strict)
