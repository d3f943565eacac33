"""A direct walk of folders and digests of files in blocks, as Spark jobs.

Folders are listed level by level: the folders of one level are a stored table, dealt over
tasks, and what they hold is the next one. So the driver holds no listing, and a folder of very many
files costs its task a stream of rows. Links are counted and not followed, so a
loop of links ends. A folder or file that cannot be read is a row with its error, never a
failed job.

Paths are local to the machines (a mounted share) or ``file:`` URIs. Digests read a file in blocks of ``BLOCK_BYTES``
whatever its size, and compare size, time and identity before and after: a
file that changed while it was read has the status ``changed`` and no digest.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsift.functions.media import classify_media, extension, normalize_path
from twinsift.plans.storage import materialize

BLOCK_BYTES = 1 << 20
FOLDER, FILE, LINK, ERROR = "folder", "file", "link", "error"
_FOUND = "path string, kind string, size_bytes long, last_write_time_utc_ms long, error string"
_DIGEST = "path string, size_bytes long, last_write_time_utc_ms long, sha512 string, status string, error string"


def local(path: str) -> str:
    """Local path of a path or ``file:`` URI."""
    return unquote(urlparse(path).path) if path.startswith("file:") else path


def entries(folder: str) -> Iterator[tuple]:
    """What a folder holds, one row each; an error of the folder itself is a row too."""
    try:
        with os.scandir(folder) as found:
            for e in found:
                try:
                    if e.is_symlink():
                        yield e.path, LINK, None, None, None
                    elif e.is_dir(follow_symlinks=False):
                        yield e.path, FOLDER, None, None, None
                    elif e.is_file(follow_symlinks=False):
                        s = e.stat(follow_symlinks=False)
                        yield e.path, FILE, s.st_size, s.st_mtime_ns // 1_000_000, None
                except OSError as problem:
                    yield e.path, ERROR, None, None, problem.strerror
    except OSError as problem:
        yield folder, ERROR, None, None, problem.strerror


def _batches(rows: Iterator[tuple], schema: str, size: int = 5_000) -> Iterator:
    import pyarrow as pa

    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [{"string": pa.string(), "long": pa.int64()}[c.split()[1]] for c in schema.split(", ")]
    held: list[tuple] = []

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True) if held else [()] * len(names), kinds, strict=True)], names)

    for row in rows:
        held.append(row)
        if len(held) == size:
            yield batch()
            held.clear()
    yield batch()


def _listed(batches: Iterator) -> Iterator:
    yield from _batches((row for b in batches for path in b.column(0).to_pylist() for row in entries(path)), _FOUND)


def walk(spark: SparkSession, roots: list[str]) -> DataFrame:
    """``_FOUND`` rows of all folders, files, links and errors under ``roots``; the roots themselves are folders."""
    level = spark.createDataFrame([(local(r),) for r in dict.fromkeys(roots)], "path string")
    none = F.lit(None)
    levels = [level.select("path", F.lit(FOLDER).alias("kind"), none.cast("long").alias("size_bytes"), none.cast("long").alias("last_write_time_utc_ms"), none.cast("string").alias("error"))]
    while True:
        # a few folders a task, as their sizes differ
        found = materialize(level.select("path").repartition(F.col("path")).mapInArrow(_listed, _FOUND), "level")
        levels.append(found)
        level = found.where(F.col("kind") == FOLDER)
        if level.isEmpty():
            break
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    return out


def files_of(found: DataFrame) -> DataFrame:
    """The files of a walk with normalised path, extension and kind of medium."""
    rows = found.where(F.col("kind") == FILE).drop("kind", "error")
    rows = rows.withColumns({"normalized_path": normalize_path("path"), "extension": extension("path")})
    return rows.withColumn("media_kind", classify_media("extension"))


def totals(found: DataFrame) -> DataFrame:
    """Folders, files, links and errors that a walk met, and the bytes of its files, in one row."""
    count = lambda kind: F.count_if(F.col("kind") == kind)
    return found.agg(count(FOLDER).alias("folders"), count(FILE).alias("files"), count(LINK).alias("links"), count(ERROR).alias("errors"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"))


def digest(path: str, block: int = BLOCK_BYTES, opened: Callable = open, stat: Callable = os.stat) -> tuple:
    """``_DIGEST`` row of one file, read in blocks."""
    seen = lambda: (s := stat(path)) and (s.st_size, s.st_mtime_ns, s.st_dev, s.st_ino)
    try:
        before, hashed = seen(), hashlib.sha512()
        with opened(path, "rb", buffering=0) as file:
            while data := file.read(block):
                hashed.update(data)
        if seen() != before:
            return path, None, None, None, "changed", None
        return path, before[0], before[1] // 1_000_000, hashed.hexdigest(), "ok", None
    except OSError as problem:
        return path, None, None, None, "error", problem.strerror


def digests(files: DataFrame, path: str = "path", block: int = BLOCK_BYTES) -> DataFrame:
    """SHA-512 of every file, with size and time as they were while it was read."""

    def hashed(batches: Iterator) -> Iterator:
        yield from _batches((digest(local(p), block) for b in batches for p in b.column(0).to_pylist()), _DIGEST, 100)

    return files.select(path).mapInArrow(hashed, _DIGEST)
