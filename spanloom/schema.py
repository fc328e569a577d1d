"""Column types of the data model."""

from __future__ import annotations


SPAN_DDL = "struct<id:string,start:int,end:int,text:string,label:string,implicit:boolean>"
RELATION_DDL = "struct<id:string,label:string,head_span_id:string,child_span_id:string,head:int,child:int>"
OPTION_DDL = "struct<id:string,text:string>"
TOKEN_DDL = "struct<id:int,text:string,start:int,end:int>"

TASK_DDL = (
    f"id string, text string, tokens array<{TOKEN_DDL}>, spans array<{SPAN_DDL}>, relations array<{RELATION_DDL}>, "
    f"label string, options array<{OPTION_DDL}>, accept array<string>, answer string, meta map<string,string>"
)

# Raw spans as they come in: either `start` or `begin`, ids and flags optional.
RAW_SPAN_DDL = "struct<id:string,start:int,begin:int,end:int,text:string,label:string,implicit:boolean>"
RAW_DOC_DDL = f"struct<version:string,text:string,layers:struct<spans:array<{RAW_SPAN_DDL}>>>"

SAMPLE_LINE_DDL = (
    f"id string, text string, spans array<{RAW_SPAN_DDL}>, gold_annotation string, gold_explanation string, "
    f"annotation string, meta map<string,string>, metadata map<string,string>"
)
CANDIDATE_LINE_DDL = (
    f"sample_id string, candidate_id string, run_id string, text string, source_text string, "
    f"runtime_annotation struct<format:string,annotation_markup:string>, annotation_markup string, "
    f"annotation_markup_legacy string, annotation string, spans array<{RAW_SPAN_DDL}>, explanation string, "
    f"model_confidence string, uncertainty_reason string, raw_response string, meta map<string,string>, metadata map<string,string>"
)
SEED_LINE_DDL = (
    "id string, title string, text string, source_type string, language string, domain string, tags array<string>, metadata map<string,string>"
)

TASK_VERSION = "anno.task.v1"
PREDICTION_VERSION = "anno.prediction.v1"
SAMPLE_VERSION = "anno.sample.v1"
CANDIDATE_VERSION = "anno.candidate.v1"
DOC_VERSION = "3.1"

REVIEW_STATUSES = ("pending", "accepted", "rejected", "ignored")
TERMINAL_RUN_STATUSES = ("completed", "failed", "cancelled", "interrupted")
