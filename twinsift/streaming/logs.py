"""Runtime log feed and written logs: repeats folded, filters, cursor reads and an append-only table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Entries that agree in these are repeats of one another; subject and message may differ.
KEY = ("severity", "task_id", "task", "stage", "operation", "status_code", "native_error")
CAPACITY = 4096
#: Kinds of written logs.
KINDS = ("operations", "execution", "failure", "scan_errors", "application_errors")
#: Rows of a log file; a longer batch goes on in the next file.
FILE_ROWS = 1_000_000
#: Sequence numbers of a range in which runs are found by themselves.
BLOCK = 65_536


def aggregated(log: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """Entries folded by key: repeats, last time and sequence, subject and message of the first entry.

    A repeat count of 0 or null counts as 1. The feed's 64-entry window is not kept; all repeats fold.
    """
    repeats = F.greatest(F.coalesce("repeat_count", F.lit(1)), F.lit(1))
    first = [F.min_by(c, "sequence").alias(c) for c in ("subject", "message") if c in log.columns]
    return log.groupBy(*key).agg(F.sum(repeats).alias("repeat_count"), F.max("ts").alias("last_ts"), F.max("sequence").alias("sequence"), *first)


def append(entries: DataFrame, folder: str, rows: int = FILE_ROWS) -> None:
    """Append entries to the written logs, in folders by ``kind``; a file holds ``rows`` rows at most.

    A kind that is none of ``KINDS`` raises before anything is written.
    """
    wrong = entries.where(~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False))).select("kind").first()
    if wrong is not None:
        raise ValueError(f"no such kind of log: {wrong['kind']}")
    entries.write.mode("append").option("maxRecordsPerFile", rows).partitionBy("kind").parquet(folder)


def written(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """Entries of one kind; other kinds' files are not read."""
    return spark.read.parquet(folder).where(F.col("kind") == kind)


def since(log: DataFrame, cursor: int) -> DataFrame:
    return log.where(F.col("sequence") > cursor)


def newest(log: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The last entries that a feed of bounded capacity holds."""
    return log.orderBy(F.desc("sequence")).limit(capacity)


def matches_task(task: str) -> Column:
    """The task itself, or text that occurs in task, stage or operation."""
    joined = F.concat(F.coalesce("task", F.lit("")), F.coalesce("stage", F.lit("")), F.coalesce("operation", F.lit("")))
    return (F.col("task") == task) | F.contains(joined, F.lit(task))


def matches_text(query: str, columns: tuple[str, ...] = ("task", "stage", "operation", "subject", "message")) -> Column:
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(F.contains(F.lower(c), F.lit(query.lower())), F.lit(False))
    return found


def run_lengths(log: DataFrame, key: tuple[str, ...] = KEY, partition: str = "task", block: int = BLOCK) -> DataFrame:
    """Runs of equal entries of one task, in order: first and last sequence and length.

    Tasks are few and may hold any number of entries, so each is cut into ranges of
    ``block`` sequence numbers. Runs are found within a range; then the first and the
    last run of each range, two rows a range, are stitched to their neighbours.
    Entries of equal or no sequence number are in no fixed order.
    """
    inside = Window.partitionBy(partition, "_b").orderBy("sequence")
    entries = log.select(partition, "sequence", F.floor(F.col("sequence") / block).alias("_b"), F.struct(*key).alias("_e"))
    entries = entries.withColumn("_c", F.when(F.lag("_e").over(inside).eqNullSafe(F.col("_e")), 0).otherwise(1))
    runs = entries.withColumn("_r", F.sum("_c").over(inside)).groupBy(partition, "_b", "_r")
    # all entries of a run are equal
    runs = runs.agg(F.any_value("_e").alias("_e"), F.min("sequence").alias("first"), F.max("sequence").alias("last"), F.count("*").alias("length"))
    runs = runs.withColumn("_edge", (F.col("_r") == 1) | (F.col("_r") == F.max("_r").over(Window.partitionBy(partition, "_b"))))

    across = Window.partitionBy(partition).orderBy("first")  # the edge runs only
    goes_on = (F.lag("_b").over(across) != F.col("_b")) & F.lag("_e").over(across).eqNullSafe(F.col("_e"))
    edges = runs.where("_edge").withColumn("_n", F.when(goes_on, 0).otherwise(1)).withColumn("_g", F.sum("_n").over(across))
    stitched = edges.groupBy(partition, "_g").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("length").alias("length"))
    columns = [partition, "first", "last", "length"]
    return runs.where("NOT _edge").select(*columns).unionByName(stitched.select(*columns))
