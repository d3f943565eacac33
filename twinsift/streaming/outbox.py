"""Outbox: sequenced operations, ordered batches, retries and at-least-once application."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from twinsift.operators.ingest import latest_operations, upsert

MAX_DELAY_S = 300
#: Operations of a batch.
BATCH = 1000
# Phases of a scan, and those from which it may be resumed.
PHASES = ("Idle", "Discovering", "Hashing", "ExtractingMedia", "Syncing", "Matching", "Deleting", "Paused", "CompletedLocal", "CompletedSynchronized", "Cancelled", "Failed", "Interrupted", "Planning", "FlushingSyncTail")
RESUMABLE = ("Discovering", "Hashing", "ExtractingMedia", "Syncing", "Planning", "FlushingSyncTail", "Paused", "CompletedLocal", "Interrupted")


def staged(ops: DataFrame, order: str = "arrival") -> DataFrame:
    """Staging buffer: of each scan, kind and key the last operation."""
    return latest_operations(ops, ["batch_scan_id", "kind", "key"], order)


def staged_counts(ops: DataFrame) -> DataFrame:
    return ops.groupBy("batch_scan_id").agg(F.count("*").alias("pending"))


def publish(staged_ops: DataFrame, base: int, order: tuple[str, ...] = ("batch_scan_id", "key", "kind")) -> DataFrame:
    """Staged operations with consecutive sequences after ``base``."""
    from twinsift.operators.report import with_ordinals

    return with_ordinals(staged_ops, F.struct(*order), "_o").withColumn("sequence", F.col("_o") + base + 1).drop("_o")


def recover(staged_ops: DataFrame, queue: DataFrame) -> DataFrame:
    """After a restart: all that earlier scans left staged, scan by scan, with sequences after those of the queue.

    Publishing again what a crash left is safe: a row that is in the queue already
    only repeats the last operation of its key.
    """
    last = queue.agg(F.coalesce(F.max("sequence"), F.lit(0)).alias("s")).first()["s"]
    return publish(staged_ops, last)


def batches(queue: DataFrame, size: int = BATCH) -> DataFrame:
    """Operations with the number of their batch: ``size`` by sequence make one, the last holds what is left."""
    from twinsift.operators.report import with_ordinals

    return with_ordinals(queue, F.struct("sequence"), "_o").withColumn("batch", F.floor(F.col("_o") / size)).drop("_o")


def backoff_ms(attempts: Column | str, base_s: int = 1) -> Column:
    """Delay before the next attempt: doubled per failure up to six times, five minutes at most."""
    attempts = F.col(attempts) if isinstance(attempts, str) else attempts
    doubled = F.lit(base_s) * F.pow(F.lit(2.0), F.least(F.greatest(attempts - 1, F.lit(0)), F.lit(6)))
    return (F.least(doubled, F.lit(float(MAX_DELAY_S))) * 1000).cast("long")


def due_batch(queue: DataFrame, now_ms: int, size: int) -> DataFrame:
    """First operations by sequence, cut at the first that is not due; if the head waits, all wait."""
    head = queue.orderBy("sequence").limit(size)
    waiting = head.where(F.col("next_attempt_utc_ms") > now_ms).agg(F.min("sequence").alias("_w"))
    return head.crossJoin(F.broadcast(waiting)).where(F.col("_w").isNull() | (F.col("sequence") < F.col("_w"))).drop("_w")


def acknowledge(queue: DataFrame, done: DataFrame) -> DataFrame:
    return queue.join(done.select("sequence"), "sequence", "left_anti")


def failed(queue: DataFrame, batch: DataFrame, now_ms: int) -> DataFrame:
    """The queue after a failed batch: its operations count an attempt and wait."""
    marked = queue.join(batch.select("sequence", F.lit(True).alias("_f")), "sequence", "left")
    attempts = F.col("attempt_count") + F.when(F.col("_f"), 1).otherwise(0)
    return marked.withColumn("next_attempt_utc_ms", F.when(F.col("_f"), now_ms + backoff_ms(attempts)).otherwise(F.col("next_attempt_utc_ms"))).withColumn("attempt_count", attempts).drop("_f").select(*queue.columns)


def resumable(runs: DataFrame, most: int = 50) -> DataFrame:
    """Scans that may be resumed, newest first."""
    return runs.where(F.col("phase").isin(*RESUMABLE)).orderBy(F.desc("updated_utc_ms"), "scan_id").limit(most)


def save_runs(runs: DataFrame, changed: DataFrame) -> DataFrame:
    """Checkpoint table after changed runs replaced those of their scans; the last change of a scan counts."""
    return upsert(runs, latest_operations(changed, ["scan_id"], "updated_utc_ms"), "scan_id")


def mark_interrupted(runs: DataFrame, scans: DataFrame, now_ms: int) -> DataFrame:
    """Checkpoint table after the given scans (``scan_id``) were marked as interrupted; unknown scans change nothing."""
    gone = runs.join(scans.select("scan_id").distinct(), "scan_id", "left_semi")
    return save_runs(runs, gone.withColumns({"phase": F.lit("Interrupted"), "updated_utc_ms": F.lit(now_ms).cast("long")}).select(*runs.columns))


def finalizable(runs: DataFrame, queue: DataFrame, staged_ops: DataFrame) -> DataFrame:
    """Locally complete scans of which nothing is staged or queued any more."""
    done = runs.where("phase = 'CompletedLocal'")
    open_scans = queue.select("batch_scan_id").union(staged_ops.select("batch_scan_id")).distinct()
    return done.join(open_scans, done["scan_id"] == open_scans["batch_scan_id"], "left_anti")


def delete_intents(log: DataFrame) -> DataFrame:
    """Last state of each intent: prepared, file_deleted or done; the first two are to be replayed."""
    return latest_operations(log, ["intent_id"]).withColumn("replay", F.col("state") != "done")


def recover_deletes(intents: DataFrame, present: DataFrame) -> DataFrame:
    """What to do with the intents that are to be replayed: ``action`` is ``drop`` or ``delete_mapping``.

    A file that is still there though its delete was prepared was never deleted: the
    intent goes. Otherwise the file is gone, and its path is to be deleted from the
    tables, which is safe to do twice. ``present`` names the intents (``intent_id``)
    whose file exists.
    """
    there = present.select("intent_id").distinct().withColumn("_there", F.lit(True))
    kept = (F.col("state") == "prepared") & F.coalesce("_there", F.lit(False))
    return intents.where("replay").join(there, "intent_id", "left").withColumn("action", F.when(kept, "drop").otherwise("delete_mapping")).drop("_there", "replay")


def run(source: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Process what is there in micro-batches; each holds the latest operation of a key, in sequence order.

    A batch may be delivered again after a failure, so ``apply`` must be idempotent (upserts and compare-and-delete are).
    """

    def batch(df: DataFrame, number: int) -> None:
        apply(latest_operations(df, ["key"], "sequence"), number)

    return source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def table_applier(base: str) -> Callable[[DataFrame, int], None]:
    """Applies batches to a table kept as the operations of each batch.

    A batch writes its latest operations, deletes too, to a folder of its own, so a
    batch that is delivered again replaces itself and no batch rewrites the table.
    """

    def apply(ops: DataFrame, number: int) -> None:
        ops.write.mode("overwrite").parquet(f"{base}/batch={number}")

    return apply


def applied_operations(spark: SparkSession, base: str, schema: str) -> DataFrame:
    """Of each key the operation with the largest sequence over all batches, whatever order they came in."""
    try:
        stored = spark.read.schema(schema).parquet(f"{base}/batch=*")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        stored = spark.createDataFrame([], schema)
    return latest_operations(stored, ["key"], "sequence")


def applied_table(spark: SparkSession, base: str, schema: str, delete: str = "delete") -> DataFrame:
    """Present rows of the table: keys whose last operation is no delete."""
    return applied_operations(spark, base, schema).where(F.col("kind") != delete)


def compact(spark: SparkSession, base: str, schema: str, into: str) -> None:
    """Write the last operation of each key as the first batch of a new table; deletes stay, as older operations may still come."""
    applied_operations(spark, base, schema).write.mode("errorifexists").parquet(f"{into}/batch=0")


_LEDGER = "batch long, first long, count long"


def publish_batch(ops: DataFrame, number: int, base: str, order: str = "arrival") -> None:
    """Stage a batch's operations and publish them with the sequences that follow those of earlier batches.

    Of each scan, kind and key the last operation by ``order`` counts. The ledger holds first sequence and
    count by batch number, so a batch that is delivered again gets the numbers it had: its
    start follows from earlier batches alone, and its rows are numbered in the order of their keys. The ledger's row is
    written last; a batch without one is not read by ``published``.
    """
    spark = ops.sparkSession
    known = spark.createDataFrame([], _LEDGER) if number == 0 else spark.read.schema(_LEDGER).parquet(f"{base}/ledger/of=*")
    before = known.where(F.col("batch") < number).agg(F.coalesce(F.max(F.col("first") + F.col("count")), F.lit(1)).alias("next")).first()["next"]
    numbered = publish(staged(ops, order), before - 1)
    numbered.write.mode("overwrite").parquet(f"{base}/queue/of={number}")
    count = spark.read.parquet(f"{base}/queue/of={number}").count()
    spark.createDataFrame([(number, before, count)], _LEDGER).coalesce(1).write.mode("overwrite").parquet(f"{base}/ledger/of={number}")


def publish_stream(source: DataFrame, base: str, checkpoint: str, order: str = "arrival") -> StreamingQuery:
    """``publish_batch`` for every micro-batch of a stream of operations."""
    put = lambda df, number: publish_batch(df, number, base, order)
    return source.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def published(spark: SparkSession, base: str, schema: str) -> DataFrame:
    """Operations of all batches that the ledger names, with their sequences."""
    done = spark.read.schema(_LEDGER).parquet(f"{base}/ledger/of=*").select(F.col("batch").alias("of"))
    # a row a batch
    return spark.read.schema(f"{schema}, sequence long, of long").option("basePath", f"{base}/queue").parquet(f"{base}/queue/of=*").join(done, "of", "left_semi").drop("of")
