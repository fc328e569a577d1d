"""SQL names for scalar helpers: temporary SQL functions, inlined by the optimizer like any expression."""

from __future__ import annotations

from pyspark.sql import SparkSession

SQL_FUNCTIONS = {
    "anno_jaccard": (
        "a ARRAY<STRING>, b ARRAY<STRING>", "DOUBLE",
        "CASE WHEN size(a) = 0 OR size(b) = 0 THEN 0D ELSE bround(size(array_intersect(a, b)) / size(array_union(a, b)), 4) END",
    ),
    "anno_span_f1": (
        "g ARRAY<STRING>, p ARRAY<STRING>", "DOUBLE",
        "CASE WHEN size(g) = 0 AND size(p) = 0 THEN 1D WHEN size(g) = 0 OR size(p) = 0 THEN 0D ELSE 2D * size(array_intersect(g, p)) / (size(array_distinct(g)) + size(array_distinct(p))) END",
    ),
    "anno_concept_loss": (
        "failed BIGINT, unstable BIGINT, missing BIGINT, extra BIGINT, mean_score DOUBLE", "DOUBLE",
        "bround(failed * 10D + unstable * 5D + missing * 1.5D + extra * 1D + (1D - mean_score) * 2D, 4)",
    ),
    "anno_token_estimate": ("t STRING", "INT", "greatest(1, int(floor(length(t) / 4)))"),
    "anno_audited": ("job STRING, task STRING, rate DOUBLE", "BOOLEAN", "rate > 0 AND double(conv(substr(sha1(concat(job, ':', task)), 1, 8), 16, 10)) / 4294967295D < rate"),
}


def register_sql_functions(spark: SparkSession) -> list[str]:
    for name, (args, result, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {result} RETURN {body}")
    return list(SQL_FUNCTIONS)
