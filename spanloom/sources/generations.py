"""Tables that change batch by batch: each batch writes new files for what it touches and then one commit that makes them count.

Layout under a folder: ``gen=<n>/bucket=<b>`` holds the rows of a bucket as batch n left them, ``commits/gen=<n>`` names the buckets that
batch n wrote. A bucket's state is its newest committed generation. Files without a commit are never read, and a batch that runs again
starts from the commits before its own, so it writes the same again. Nothing is deleted here.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 64


def commits(spark: SparkSession, target: str, before: int | None = None) -> DataFrame:
    """(bucket, gen): every bucket with its newest committed generation, at most one row per bucket."""
    try:
        rows = spark.read.parquet(f"{target}/commits")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "bucket int, gen bigint")
    if before is not None:
        rows = rows.where(F.col("gen") < before)
    return rows.groupBy("bucket").agg(F.max("gen").cast("bigint").alias("gen"))


def last_commit(spark: SparkSession, target: str) -> int:
    """The newest committed generation, -1 before the first."""
    row = commits(spark, target).agg(F.max("gen").alias("gen")).first()
    return -1 if row["gen"] is None else int(row["gen"])


def _files(spark: SparkSession, target: str, schema: StructType, live: list) -> DataFrame:
    if not live:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{target}/gen={r['gen']}/bucket={r['bucket']}" for r in live])


def read_state(spark: SparkSession, target: str, schema: StructType, before: int | None = None) -> DataFrame:
    """All rows as the last commit (before a generation) left them."""
    return _files(spark, target, schema, commits(spark, target, before).collect())  # a row per bucket


def newest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of highest order per key, with partial aggregation. Rows that tie in all of ``order`` are decided by their other columns."""
    rest = [c for c in rows.columns if c not in keys]
    simple = [F.to_json(F.struct(c)) if rows.schema[c].dataType.typeName() in ("map", "struct", "array") else F.col(c) for c in rest if c not in order]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], *[c.alias(f"r{i}") for i, c in enumerate(simple)])).alias("row_"))
    return best.select(*keys, *[F.col(f"row_.{c}").alias(c) for c in rest]).select(*rows.columns)


def upsert_generation(rows: DataFrame, target: str, gen: int, keys: list[str], order: list[str], buckets: int = BUCKETS) -> int:
    """Inserts or replaces by key, newest by ``order``. Reads and writes only buckets that hold a key of the batch; gives their number."""
    spark, schema = rows.sparkSession, rows.schema
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    rows = newest(rows, keys, order).withColumn("bucket", bucket)
    touched = {r["bucket"] for r in rows.select("bucket").distinct().collect()}
    if not touched:
        return 0
    live = [r for r in commits(spark, target, gen).collect() if r["bucket"] in touched]
    both = _files(spark, target, schema, live).unionByName(rows.drop("bucket"))
    merged = newest(both, keys, order).withColumn("bucket", bucket)
    merged.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/gen={gen}")
    spark.createDataFrame([(b,) for b in sorted(touched)], "bucket int").coalesce(1).write.mode("overwrite").parquet(f"{target}/commits/gen={gen}")
    return len(touched)


def append_generation(rows: DataFrame, target: str, gen: int) -> None:
    """New rows as a generation of their own, in bucket ``gen``: they count from the commit on, all or none."""
    rows.write.mode("overwrite").parquet(f"{target}/gen={gen}/bucket={gen}")
    rows.sparkSession.createDataFrame([(gen,)], "bucket int").coalesce(1).write.mode("overwrite").parquet(f"{target}/commits/gen={gen}")
