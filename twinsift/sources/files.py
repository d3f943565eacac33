"""File listings, manifests and key-ordered scans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsift.functions.media import classify_media, extension, normalize_path
from twinsift.operators.ingest import assign_root, uncovered_roots
from twinsift.sources.schemas import MANIFEST


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """All files under a folder (or one file): path, size, time, extension and kind; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    out = files.select("path", F.col("length").alias("size_bytes"), F.unix_millis("modificationTime").alias("last_write_time_utc_ms"))
    out = out.withColumns({"normalized_path": normalize_path("path"), "extension": extension("path")})
    return out.withColumn("media_kind", classify_media("extension"))


def sha512(content: Column) -> Column:
    return F.sha2(content, 512)


def hash_files(spark: SparkSession, root: str, hasher: Callable[[Column], Column] = sha512) -> DataFrame:
    """Files with the digest of their contents, SHA-512 unless another column expression is given."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.select("path", F.col("length").alias("size_bytes"), hasher(F.col("content")).alias("sha512"))


def indexed_files(listing: DataFrame, roots: DataFrame, path: str = "normalized_path") -> DataFrame:
    """Rows of a listing table under the uncovered roots, with their first configured root."""
    open_roots = uncovered_roots(roots)
    return assign_root(listing, roots.join(open_roots.select("root"), "root", "left_semi"), path).where("root IS NOT NULL")


def with_fallback(indexed: DataFrame, native: DataFrame, roots: DataFrame) -> DataFrame:
    """Indexed rows, and rows of the direct walk for those roots of which the index gave nothing."""
    empty = roots.select("root").join(indexed.select("root").distinct(), "root", "left_anti")
    return indexed.unionByName(native.join(empty, "root", "left_semi"), allowMissingColumns=True)


def write_file_lists(files: DataFrame, folder: str, disk: str = "disk", path: str = "path") -> None:
    """One folder of sorted text per disk."""
    rows = files.select(disk, path).distinct().repartitionByRange(disk, path).sortWithinPartitions(disk, path)
    rows.write.partitionBy(disk).text(folder)


def write_manifest(files: DataFrame, folder: str) -> None:
    """JSON lines by disk."""
    files.write.partitionBy("storage_target_key").json(folder)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(MANIFEST).json(folder)


def prefix_scan(rows: DataFrame, prefix: str, key: str = "key", most: int | None = None) -> DataFrame:
    """Rows whose key starts with a prefix, in key order."""
    out = rows.where(F.col(key).startswith(prefix)).orderBy(key)
    return out if most is None else out.limit(most)


def active_paths(paths: DataFrame) -> DataFrame:
    return paths.where("active")


def visual_contents(contents: DataFrame, paths: DataFrame, sha: str = "sha512") -> DataFrame:
    """Images and videos that an active path has."""
    return contents.where(F.col("media_kind").isin(1, 2)).join(active_paths(paths).select(sha), sha, "left_semi")


def lookup(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Rows of the wanted keys."""
    return rows.join(wanted.select(key).distinct(), key, "left_semi")


def file_kind(path: Column | str) -> Column:
    return classify_media(extension(path))
