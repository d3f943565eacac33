"""The live log feed as a stateful stream: bounded entries per feed, repeats folded within a window.

A feed keeps its last ``CAPACITY`` entries. A new entry that agrees with one of the last
``WINDOW`` in the key columns is folded into it: the entry counts the repeats and moves to the
end with a new sequence number and time; subject and message stay those of the first. Any other one
is appended with the next entry id; beyond the capacity the oldest goes and is counted as dropped.

The state of a feed is its entries and three numbers, whatever the stream's length; each batch leaves
the states beside its rows, and the next one goes on from them. Rows of a
batch are taken in the order of ``sequence``. A feed is sequential by its definition, so its rows
of a batch go to one task, sorted by Spark; the task reads them in pieces and holds no more than a piece
and the state. Different feeds are spread. After each batch the
touched entries and the feed's numbers leave as rows with the version of the feed; a reader takes the latest row
of each entry (``snapshot``). A batch that is delivered again gives the same rows.

Null repeat counts, and those below one, are one; line breaks and tabs in texts become spaces.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from twinsift.plans.storage import arrow_rows
from twinsift.streaming.logs import CAPACITY, KEY

WINDOW = 64
_SPACES = str.maketrans("\r\n\t", "   ")
TEXTS = ("task", "stage", "operation", "subject", "message")
INPUT = "feed string, sequence long, utc_ms long, severity string, task_id long, task string, stage string, operation string, subject string, message string, status_code long, native_error long, repeat_count long"
_COLUMNS = [c.split()[0] for c in INPUT.split(", ")]
_FIELDS = [c for c in _COLUMNS if c not in ("feed", "sequence", "utc_ms", "repeat_count")]
_ENTRY = "feed string, version long, entry_id long, sequence long, dropped long, live boolean, utc_ms long, repeat_count long, fields string"
_FOLDED = f"kind string, {_ENTRY}, state string"


class Feed:
    """One feed's entries in order; ``touched`` collects what changed."""

    def __init__(self, state: str | None = None, capacity: int = CAPACITY, window: int = WINDOW):
        held = json.loads(state) if state else {"entries": [], "next_id": 1, "next_sequence": 1, "dropped": 0}
        self.entries: list[dict] = held["entries"]
        self.next_id, self.next_sequence, self.dropped = held["next_id"], held["next_sequence"], held["dropped"]
        self.capacity, self.window, self.touched, self.gone, self.changed = capacity, window, {}, [], False

    def state(self) -> str:
        return json.dumps({"entries": self.entries, "next_id": self.next_id, "next_sequence": self.next_sequence, "dropped": self.dropped})

    def publish(self, fields: dict, utc_ms: int | None, repeats: int | None) -> None:
        fields = fields | {c: fields[c].translate(_SPACES) for c in TEXTS if fields[c] is not None}
        self.changed = True
        key = [fields[c] for c in KEY]
        repeats = max(repeats or 1, 1)
        for at in range(len(self.entries) - 1, max(len(self.entries) - self.window, 0) - 1, -1):
            if self.entries[at]["key"] == key:
                entry = self.entries.pop(at)
                entry["repeats"] += repeats
                break
        else:
            entry = {"id": self.next_id, "key": key, "repeats": repeats, "fields": fields}
            self.next_id += 1
        entry |= {"sequence": self.next_sequence, "utc_ms": utc_ms}
        self.next_sequence += 1
        self.entries.append(entry)
        self.touched[entry["id"]] = entry
        if len(self.entries) > self.capacity:
            old = self.entries.pop(0)
            self.touched.pop(old["id"], None)
            self.gone.append(old["id"])
            self.dropped += 1


def _fold(capacity: int, window: int):
    def fold(batches: Iterator) -> Iterator:
        """Rows and new states of feeds, from their states and then their rows by sequence, a batch at a time."""
        import pyarrow as pa

        kinds = pa.schema([(c.split()[0], {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}[c.split()[1]]) for c in _FOLDED.split(", ")])
        out: list[tuple] = []
        name, feed = None, None

        def gone():
            out.extend(("entry", name, feed.next_sequence - 1, i, None, None, False, None, None, None, None) for i in feed.gone)
            feed.gone.clear()

        def end():
            gone()
            version = feed.next_sequence - 1
            if feed.changed:
                out.extend(("entry", name, version, e["id"], e["sequence"], None, True, e["utc_ms"], e["repeats"], json.dumps(e["fields"]), None) for e in feed.touched.values())
                out.append(("entry", name, version, 0, version, feed.dropped, None, None, None, None, None))
            out.append(("state", name, None, None, None, None, None, None, None, None, feed.state()))

        def ready():
            done = pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds.types, strict=True)], schema=kinds)
            out.clear()
            return done

        for batch in batches:
            for r in batch.to_pylist():
                if feed is None or r["feed"] != name:
                    if feed is not None:
                        end()
                    name, feed = r["feed"], Feed(r["state"], capacity, window)
                if r["state"] is None:
                    feed.publish({c: r[c] for c in _FIELDS}, r["utc_ms"], r["repeat_count"])
            if feed is not None:
                gone()
            if out:
                yield ready()
        if feed is not None:
            end()
            yield ready()

    return fold


def _batches(spark: SparkSession, base: str) -> list[int]:
    """Numbers of the batches that have been written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/rows")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return [int(s.getPath().getName()[6:]) for s in fs.listStatus(path)] if fs.exists(path) else []


def _put(batch: DataFrame, number: int, base: str, capacity: int, window: int) -> None:
    """Fold a batch into the states that the one before left; its rows and the new states are written together."""
    spark = batch.sparkSession
    arrow_rows(spark)
    before = [n for n in _batches(spark, base) if n < number]
    rows = batch.select(*_COLUMNS, F.lit(None).cast("string").alias("state"))
    if before:
        held = spark.read.schema(f"{INPUT}, state string").parquet(f"{base}/rows/batch={max(before)}/kind=state")
        rows = rows.unionByName(held.select(*[F.col(c) if c in ("feed", "state") else F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns]))
    ordered = rows.repartition("feed").sortWithinPartitions("feed", F.col("state").isNull(), F.col("sequence").asc_nulls_last())
    ordered.mapInArrow(_fold(capacity, window), _FOLDED).write.mode("overwrite").partitionBy("kind").parquet(f"{base}/rows/batch={number}")


def run(source: DataFrame, base: str, capacity: int = CAPACITY, window: int = WINDOW) -> StreamingQuery:
    """Feed a stream of ``INPUT`` rows; each batch's rows are written to a folder of its own, so that a repeated batch replaces itself."""
    put = lambda batch, number: _put(batch, number, base, capacity, window)
    return source.select(*_COLUMNS).writeStream.foreachBatch(put).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()


def _latest(spark: SparkSession, base: str) -> DataFrame:
    """The last row of each entry and, as entry 0, of each feed's numbers."""
    rows = spark.read.schema(_ENTRY).parquet(f"{base}/rows/batch=*/kind=entry")
    rest = [c for c in rows.columns if c not in ("feed", "entry_id")]
    return rows.groupBy("feed", "entry_id").agg(F.max_by(F.struct(*rest), "version").alias("r")).select("feed", "entry_id", "r.*")


def snapshot(spark: SparkSession, base: str, after: int = 0) -> DataFrame:
    """Live entries with a sequence number above ``after``: ``feed``, ``entry_id``, ``sequence``, ``utc_ms``, ``repeat_count`` and the entry's fields."""
    fields = ", ".join(c for c in INPUT.split(", ") if c.split()[0] not in ("feed", "sequence", "utc_ms", "repeat_count"))
    live = _latest(spark, base).where(F.col("live") & (F.col("sequence") > after))
    return live.withColumn("f", F.from_json("fields", fields)).select("feed", "entry_id", "sequence", "utc_ms", "repeat_count", "f.*")


def counters(spark: SparkSession, base: str) -> DataFrame:
    """``(feed, latest_sequence, dropped)``."""
    return _latest(spark, base).where("entry_id = 0").select("feed", F.col("sequence").alias("latest_sequence"), "dropped")
