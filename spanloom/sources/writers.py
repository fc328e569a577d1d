"""Writers: JSON lines of tasks, samples, candidates and predictions, and the label-studio form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.markup import spans_to_markup
from ..schema import CANDIDATE_VERSION, PREDICTION_VERSION, RELATION_DDL, SAMPLE_VERSION, TASK_VERSION, OPTION_DDL

KEEP_NULLS = {"ignoreNullFields": "false"}


def numbered_spans(spans: Column) -> Column:
    """Spans with ids T1, T2, … in list order."""
    return F.transform(
        spans,
        lambda s, i: F.struct(
            F.concat(F.lit("T"), (i + 1).cast("string")).alias("id"), s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"),
            s["label"].alias("label"), s["implicit"].alias("implicit"),
        ),
    )


def _or_empty(df: DataFrame, name: str, ddl: str) -> Column:
    return (F.col(name) if name in df.columns else F.array().cast(f"array<{ddl}>")).alias(name)


def _meta(df: DataFrame) -> Column:
    return (F.col("meta") if "meta" in df.columns else F.create_map().cast("map<string,string>")).alias("meta")


def task_payload(df: DataFrame, version: str = TASK_VERSION, renumber: bool = True) -> Column:
    answer = F.col("answer") if "answer" in df.columns else F.lit(None).cast("string")
    return F.struct(
        F.lit(version).alias("schema_version"), "id", "text", _or_empty(df, "tokens", "struct<id:int,text:string,start:int,end:int>"),
        (numbered_spans(F.col("spans")) if renumber else F.col("spans")).alias("spans"), _or_empty(df, "relations", RELATION_DDL), _or_empty(df, "options", OPTION_DDL),
        _or_empty(df, "accept", "string"), answer.alias("answer"), _meta(df),
    )


def task_records(tasks: DataFrame) -> DataFrame:
    return tasks.select("id", F.to_json(task_payload(tasks), KEEP_NULLS).alias("value"))


def sample_records(samples: DataFrame) -> DataFrame:
    payload = F.struct(
        F.lit(SAMPLE_VERSION).alias("schema_version"), "id", "text", F.array().cast("array<string>").alias("tokens"), numbered_spans(F.col("spans")).alias("spans"),
        F.array().cast("array<string>").alias("relations"), F.lit("accept").alias("answer"), _meta(samples),
    )
    return samples.select("id", F.to_json(payload, KEEP_NULLS).alias("value"))


def candidate_records(candidates: DataFrame) -> DataFrame:
    text = lambda c: (F.col(c) if c in candidates.columns else F.lit("")).alias(c)
    markup = F.col("annotation_markup") if "annotation_markup" in candidates.columns else spans_to_markup(F.col("spans"))
    payload = F.struct(
        F.lit(CANDIDATE_VERSION).alias("schema_version"), "sample_id", "candidate_id", "text", F.array().cast("array<string>").alias("tokens"), numbered_spans(F.col("spans")).alias("spans"),
        F.array().cast("array<string>").alias("relations"), F.lit(None).cast("string").alias("answer"),
        F.struct(F.lit("inline_markup.v1").alias("format"), markup.alias("annotation_markup")).alias("runtime_annotation"),
        text("explanation"), "model_confidence", text("uncertainty_reason"), text("raw_response"), _meta(candidates),
    )
    return candidates.select("sample_id", "candidate_id", F.to_json(payload, KEEP_NULLS).alias("value"))


def prediction_payload(df: DataFrame) -> Column:
    return F.struct(
        F.lit(PREDICTION_VERSION).alias("schema_version"), F.col("prediction_id").alias("id"), "task_id", "source", "model", "spans", "score", F.struct("rule_risk").alias("meta")
    )


def prediction_records(predictions: DataFrame) -> DataFrame:
    return predictions.select("prediction_id", F.to_json(prediction_payload(predictions), KEEP_NULLS).alias("value"))


def labelstudio_items(tasks: DataFrame, predictions: DataFrame, order: str = "run") -> DataFrame:
    """One JSON item per task with its predictions nested, as the target format demands (a task and its runs are one document)."""
    nested = predictions.select(
        F.col("task_id").alias("id"),
        F.struct(
            F.col(order).alias("at"),
            F.struct(F.coalesce(F.nullif("model", F.lit("")), "source").alias("model_version"), "score", prediction_payload(predictions).alias("result")).alias("p"),
        ).alias("x"),
    ).groupBy("id").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    items = tasks.select("id", "text", task_payload(tasks, renumber=False).alias("task")).join(nested, "id", "left")
    payload = F.struct("id", F.struct("text", "task").alias("data"), F.transform("xs", lambda x: x["p"]).alias("predictions"))
    return items.select("id", F.to_json(payload).alias("value"))


def write_jsonl(records: DataFrame, path: str, mode: str = "error") -> None:
    """One line per record, in as many files as there are partitions."""
    records.select("value").write.mode(mode).text(path)


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "error") -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
