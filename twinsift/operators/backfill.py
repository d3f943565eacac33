"""Backfill of missing image features: an outcome per content, counters, and batches whose checkpoint comes last.

A batch writes its features first and its checkpoint, one file, second. Features
without a checkpoint count as never written, so a backfill that is lost at any
moment repeats at most its last batch and never claims what is not there.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsift.operators.exact import incomplete_with_paths

#: Status of an attempt on a path, and outcomes of a content.
OK, UNREADABLE, TIMEOUT, DECODE = "ok", "unreadable", "timeout", "decode"
COMPLETED, NO_PATH, TIMED_OUT, DECODE_FAILED = "completed", "no_readable_path", "timeout", "decode_failed"


def targets(contents: DataFrame, paths: DataFrame, missing: Column, sha: str = "sha") -> DataFrame:
    """Contents that lack features, with their active paths, one row a path; ``missing`` is ``media.missing_features``."""
    return incomplete_with_paths(contents, paths, F.size(missing) == 0, sha)


def outcomes(attempts: DataFrame, sha: str = "sha") -> DataFrame:
    """One row a content: its outcome, and the path and features of its first good attempt by priority and path id.

    ``attempts`` has ``status`` and ``features`` for each path of a content. An
    aggregate: of a content that very many paths share, each task passes on one row.
    A null or unknown status counts as a failed decoding.
    """
    place = F.struct("scan_root_priority", "path_id")
    good = F.when(F.col("status") == OK, place)
    found = attempts.groupBy(sha).agg(
        F.min(good)["path_id"].alias("path_id"), F.min_by("features", good).alias("features"), F.min(good).isNotNull().alias("_ok"),
        F.bool_or(~F.col("status").eqNullSafe(UNREADABLE)).alias("_read"), F.bool_or(F.col("status").eqNullSafe(TIMEOUT)).alias("_late"),
    )
    outcome = F.when(F.col("_ok"), COMPLETED).when(~F.col("_read"), NO_PATH).when(F.col("_late"), TIMED_OUT).otherwise(DECODE_FAILED)
    return found.withColumn("outcome", outcome).drop("_ok", "_read", "_late")


def counters(done: DataFrame, sha: str = "sha") -> DataFrame:
    """One row: contents by outcome, all failures together, and the last content in digest order."""
    by = [F.count_if(F.col("outcome") == o).alias(o) for o in (COMPLETED, NO_PATH, TIMED_OUT, DECODE_FAILED)]
    return done.agg(F.max(sha).alias("last_sha"), F.count("*").alias("processed"), F.count_if(F.col("outcome") != COMPLETED).alias("failed"), *by)


def save_batch(base: str, number: int, done: DataFrame, sha: str = "sha") -> None:
    """Write the outcomes of a batch, then its checkpoint; what a lost batch of that number left is replaced."""
    kept = checkpoints(done.sparkSession, base)
    if kept is not None and not kept.where(F.col("batch") == number).isEmpty():
        raise ValueError(f"batch {number} is complete")
    features = f"{base}/features/batch={number}"
    done.write.mode("overwrite").parquet(features)
    stored = done.sparkSession.read.schema(done.schema).parquet(features)
    counters(stored, sha).coalesce(1).write.mode("overwrite").parquet(f"{base}/checkpoint/batch={number}")


def checkpoints(spark: SparkSession, base: str) -> DataFrame | None:
    """Counters of all complete batches by ``batch``; None before the first."""
    try:
        return spark.read.parquet(f"{base}/checkpoint")
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def saved(spark: SparkSession, base: str, schema: str) -> DataFrame:
    """Outcomes of all batches that have a checkpoint."""
    kept = checkpoints(spark, base)
    if kept is None:
        return spark.createDataFrame([], schema)
    stored = spark.read.schema(f"{schema}, batch int").parquet(f"{base}/features")
    return stored.join(kept.select("batch"), "batch", "left_semi").drop("batch")


def pending(wanted: DataFrame, done: DataFrame, sha: str = "sha") -> DataFrame:
    """Targets of which no batch has completed the content; failed ones are tried again."""
    return wanted.join(done.where(F.col("outcome") == COMPLETED).select(sha), sha, "left_anti")
