"""Batch inference with a pluggable predictor."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.markup import relocate_spans
from ..functions.responses import confidence_of, parse_response
from ..functions.spans import empty_spans, rule_risk

Predictor = Callable[[pd.Series], pd.Series]


def batch_infer(tasks: DataFrame, predict: Predictor, k: int, prompt: str = "prompt", key: str = "task_id") -> DataFrame:
    """k samples per task: raw responses with an error text where the predictor failed on a prompt.

    ``predict`` maps a series of prompts to a series of responses and runs inside the tasks. When a whole batch fails, its prompts are
    tried one by one, so that one bad prompt fails alone. A lost executor repeats its batches: the predictor must allow that.
    """
    runs = tasks.select(key, F.col(prompt).alias("prompt_"), F.explode(F.sequence(F.lit(1), F.lit(k))).alias("run"))

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            try:
                raw, error = predict(batch["prompt_"]), None
            except Exception:
                raw, error = [], []
                for text in batch["prompt_"]:
                    try:
                        raw.append(predict(pd.Series([text])).iloc[0])
                        error.append(None)
                    except Exception as exc:
                        raw.append(None)
                        error.append(f"{type(exc).__name__}: {exc}")
            yield pd.DataFrame({key: batch[key], "run": batch["run"], "raw": list(raw), "error": error})

    kind = tasks.schema[key].dataType.simpleString()
    return runs.mapInPandas(call, f"{key} {kind}, run int, raw string, error string")


def lexicon_response(text: Column, lexicon: list[tuple[str, str]]) -> Column:
    """The default predictor, in expressions: marks the lexicon words of a text. The lexicon is a short fixed list."""
    marks = [F.when(F.contains(text, F.lit(w)), F.lit(f"[{w}]{{{label}}}")) for w, label in lexicon]
    return F.to_json(F.struct(text.alias("text"), F.array_join(F.array_compact(F.array(*marks)), " ").alias("annotation"), F.lit("lexicon").alias("explanation"), F.lit(0.9).alias("confidence")))


def responses_to_predictions(responses: DataFrame, tasks: DataFrame, key: str = "task_id") -> DataFrame:
    """Predictions from raw responses: parsed spans placed in the text, confidence and rule risk."""
    rows = responses.join(tasks.select(key, "text"), key).withColumn("p", parse_response(F.col("raw")))
    rows = rows.withColumn("warning", F.when(F.col("error").isNotNull(), "call_failed").otherwise(F.col("p.warning")))
    rows = rows.withColumn("spans", F.coalesce(relocate_spans(F.col("p.spans"), F.col("text")), empty_spans()))
    default = F.when(F.col("warning").isNull(), 0.7).otherwise(0.2)
    return rows.select(
        F.concat_ws("-", F.lit("pred"), F.col(key).cast("string"), F.col("run").cast("string")).alias("prediction_id"), key, "run", "text", "spans",
        F.coalesce(confidence_of(F.col("raw"), default), default).alias("score"), rule_risk(F.col("spans"), F.col("text"), F.col("warning")).alias("rule_risk"), "warning",
    )
