"""Shared storage for intermediate tables and Arrow batch sizing."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors share.

    It is ``spark.checkpoint.dir`` of the session. Only a session in one local
    process (``local[...]``, as in tests) may go without it and then gets a
    temporary folder; on a cluster a missing setting is an error, because a
    machine-local folder would not be seen by the other machines.
    """
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="twinsift-")
    spark.sparkContext.setCheckpointDir(f"file://{folder}")
    return spark.sparkContext.getCheckpointDir()


def intermediates(spark: SparkSession) -> str:
    """Folder of this application's intermediate tables."""
    return f"{shared_dir(spark)}/twinsift/{spark.sparkContext.applicationId}"


def drop_intermediates(spark: SparkSession) -> None:
    """Delete this application's intermediate tables, once the results that read them are written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(intermediates(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str = "t", by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back; ``by`` names columns of folders.

    This cuts the lineage: a lost executor costs a re-read, not a recomputation,
    and a plan that uses the table twice computes it once.
    """
    spark = df.sparkSession
    path = f"{intermediates(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path, partitionBy=by)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a task that looks for equal ones.
UNIQUE_ROWS = 1_000_000


def dealt(stored: DataFrame, *keys: str, rows: int = UNIQUE_ROWS) -> DataFrame:
    """A stored table dealt by ``keys`` into tasks of about ``rows`` rows before it is aggregated by them.

    Where nearly all keys differ, an aggregation before the shuffle only holds a scan's rows, and files of
    well-packed ids have very many.
    """
    least = int(stored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored.repartition(max(least, -(-stored.count() // rows)), *keys)


#: Bytes of an Arrow batch; one row may hold more.
ARROW_BYTES = 16 << 20


def arrow_rows(spark: SparkSession, rows: int = 1000) -> None:
    """Bound the rows and the bytes of the session's Arrow batches, as one row may hold a very long text.

    A session setting is lowered where it is higher and never raised.
    """
    for key, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", ARROW_BYTES)):
        name = f"spark.sql.execution.arrow.{key}"
        now = int(spark.conf.get(name, None) or 0)
        if now <= 0 or now > most:
            spark.conf.set(name, str(most))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` is called so."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = f"_{name}"
    return name
