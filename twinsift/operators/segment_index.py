"""A stored segment index for Hamming candidates that grows by batches.

The index rows of ``simjoin`` (a row per chosen segment of a word) are kept in a
table that is bucketed by segment value, one partition a batch. A batch of new
words probes it: only the new rows are keyed and shuffled, the stored ones are read
bucket by bucket as they lie. The table is named in the session's catalog and lies in
``base``, so another session finds it by its folder.

Values that are hot in a batch are stored in parts by a hash of the id, and the number of
parts of each (at most ``CHOICE_KEYS`` values a batch) in a table beside; new
rows probe all parts of such a value, so no bucket takes it whole.

Writing a batch again replaces it, so a failed run can be repeated. The first batch is any
batch; batches are numbers that the caller counts up.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsift.operators import simjoin
from twinsift.operators.components import connected_components
from twinsift.operators.joins import hot_counts
from twinsift.operators.simjoin import Blocking
from twinsift.plans.storage import materialize

BUCKETS = 256
_HOT = "seg int, key long, parts int, batch long"


class SegmentIndex:
    """Stored index of ``(id long, w)`` rows for one blocking; ``word`` is the type of ``w``."""

    def __init__(self, spark: SparkSession, base: str, blocking: Blocking, word: str = "bigint", buckets: int = BUCKETS, hot_rows: int = simjoin.CHOICE_ROWS):
        self.spark, self.base, self.blocking, self.buckets, self.hot_rows = spark, base.rstrip("/"), blocking, buckets, hot_rows
        self.table = "segments_" + hashlib.md5(self.base.encode()).hexdigest()
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} (right_id BIGINT, rw {word}, seg INT, key BIGINT, chosen ARRAY<INT>, slot BIGINT, batch BIGINT) USING parquet "
            f"OPTIONS (path '{self.base}/segments') PARTITIONED BY (batch) CLUSTERED BY (slot) INTO {buckets} BUCKETS"
        )
        if self._exists("segments"):
            spark.sql(f"MSCK REPAIR TABLE {self.table}")

    def _exists(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def _hot(self, batch: int) -> DataFrame | None:
        """Most parts of each value that an earlier batch stored in parts."""
        if not self._exists("hot"):
            return None
        return self.spark.read.schema(_HOT).parquet(f"{self.base}/hot").where(F.col("batch") < batch).groupBy("seg", "key").agg(F.max("parts").alias("parts"))

    @staticmethod
    def _slot(part: Column) -> Column:
        return F.xxhash64("seg", "key", part)

    def add(self, batch: int, rows: DataFrame) -> None:
        """Store the index rows of a batch; rows with null ids or words are left out."""
        keyed = materialize(simjoin.index_rows(rows.where("id IS NOT NULL AND w IS NOT NULL"), self.blocking, hot_rows=self.hot_rows), "keyed")
        hot = hot_counts(keyed, ["seg", "key"], simjoin.CHOICE_KEYS, self.hot_rows).select("seg", "key", F.ceil(F.col("n") / self.hot_rows).cast("int").alias("parts"))
        hot = materialize(hot, "hot")
        dealt = keyed.join(F.broadcast(hot), ["seg", "key"], "left")
        part = F.pmod(F.xxhash64("right_id"), F.coalesce("parts", F.lit(1))).cast("int")
        stored = dealt.select("right_id", "rw", "seg", "key", "chosen", self._slot(part).alias("slot"), F.lit(batch).cast("long").alias("batch"))
        hot.withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{self.base}/hot")
        # one file a bucket and batch
        ready = stored.repartition(self.buckets, "slot").select(*self.spark.table(self.table).columns)
        ready.createOrReplaceTempView(f"{self.table}_new")
        self.spark.sql(f"INSERT OVERWRITE TABLE {self.table} PARTITION (batch = {int(batch)}) SELECT right_id, rw, seg, key, chosen, slot FROM {self.table}_new")

    def find(self, rows: DataFrame, before: int | None = None) -> DataFrame:
        """``(left_id, right_id, distance)``: for each of ``rows`` the stored words within the radius, of batches below ``before`` only."""
        before = (1 << 62) if before is None else before
        probes, hot = simjoin.probe_rows(rows.where("id IS NOT NULL AND w IS NOT NULL"), self.blocking), self._hot(before)
        if hot is not None:
            probes = probes.join(F.broadcast(hot), ["seg", "key"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
        else:
            probes = probes.withColumn("part", F.lit(0))
        slots = probes.select("left_id", "lw", self._slot(F.col("part")).alias("slot"), F.col("seg").alias("l_seg"), F.col("key").alias("l_key"))
        stored = self.spark.table(self.table).where(F.col("batch") < before).drop("batch")
        # written so that ``slot`` stays the only join key: the index is laid out by it
        same = ((F.col("l_seg") - F.col("seg")) == 0) & (F.col("l_key").bitwiseXOR(F.col("key")) == 0)
        met = slots.hint("merge").join(stored, "slot").where(same)
        return simjoin.near_only(met, self.blocking)

    def extend(self, batch: int, rows: DataFrame) -> DataFrame:
        """Pairs of a new batch among itself and with all earlier batches, left id smaller; the batch is stored."""
        old = self.find(rows, batch).select(F.least("left_id", "right_id").alias("left_id"), F.greatest("left_id", "right_id").alias("right_id"), "distance")
        own = simjoin.self_pairs(rows.where("id IS NOT NULL AND w IS NOT NULL"), self.blocking)
        edges = materialize(old.where("left_id <> right_id").unionByName(own), "edges")
        self.add(batch, rows)
        return edges


def merge_components(stored: DataFrame, edges: DataFrame) -> DataFrame:
    """``(id, component)`` after new edges, from stored components; ``component`` is the smallest node.

    Nodes that edges name are put in place of their components first, so components are
    found among those that new edges touch; all others keep their rows.
    """
    ends = edges.select(F.explode(F.array("left_id", "right_id")).alias("id")).distinct()
    touched = materialize(ends.join(stored, "id", "left").select("id", F.coalesce("component", "id").alias("component")), "touched")
    by = lambda c: touched.select(F.col("id").alias(c), F.col("component").alias(f"{c}_part"))
    across = edges.join(by("left_id"), "left_id").join(by("right_id"), "right_id").where("left_id_part <> right_id_part")
    moved = materialize(connected_components(across, "left_id_part", "right_id_part").select(F.col("id").alias("component"), F.col("component").alias("into")), "moved")
    whole = stored.unionByName(touched.join(stored.select("id"), "id", "left_anti"))
    return whole.join(moved, "component", "left").select("id", F.coalesce("into", "component").alias("component"))
