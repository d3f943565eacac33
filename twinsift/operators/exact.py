"""Exact duplicate groups by content digest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def exact_groups(members: DataFrame, sha: str = "sha", id_col: str = "path_id", size: str = "size_bytes") -> DataFrame:
    """Groups of at least two members: count, smallest id, its size and the bytes that all others hold.

    Minima and counts combine before the shuffle, so one digest that a third of all
    rows share moves one row per task.
    """
    grouped = members.where(F.col(sha).isNotNull()).groupBy(F.col(sha).alias("sha"))
    first = F.min(F.struct(F.col(id_col).alias("id"), F.col(size).alias("size")))
    out = grouped.agg(F.count("*").alias("member_count"), first.alias("first")).where("member_count >= 2")
    return out.select("sha", "member_count", F.col("first.id").alias("first_id"), F.col("first.size").alias("size_bytes"), (F.col("first.size") * (F.col("member_count") - 1)).alias("reclaimable_bytes"))


def group_members(members: DataFrame, groups: DataFrame, sha: str = "sha") -> DataFrame:
    """Members of the given groups, all columns; groups are joined on the digest."""
    return members.join(groups.select(F.col("sha").alias(sha), "member_count"), sha)


def join_contents(paths: DataFrame, contents: DataFrame, sha: str = "sha") -> tuple[DataFrame, DataFrame]:
    """Paths with their contents, and the paths whose content is missing (an integrity report instead of an error)."""
    marked = contents.withColumn("_there", F.lit(True))
    joined = paths.join(marked, sha, "left")
    return joined.where("_there").drop("_there"), joined.where("_there IS NULL").select(*paths.columns)


def active_semi(contents: DataFrame, paths: DataFrame, sha: str = "sha") -> DataFrame:
    """Contents that at least one active path has."""
    return contents.join(paths.where("active").select(sha), sha, "left_semi")


def completeness(contents: DataFrame, complete) -> DataFrame:
    """Total, complete and incomplete contents."""
    counted = contents.agg(F.count("*").alias("total"), F.count_if(complete).alias("complete"))
    return counted.withColumn("incomplete", F.col("total") - F.col("complete"))


def incomplete_with_paths(contents: DataFrame, paths: DataFrame, complete, sha: str = "sha") -> DataFrame:
    """Incomplete contents with their active paths, one row a path.

    Rows and not an array a content: a content that very many paths share stays many
    rows. Sort by ``sha``, ``scan_root_priority`` and ``path_id`` for the order of work.
    """
    places = paths.where("active").select(sha, "scan_root_priority", "path_id", "full_path")
    return contents.where(~F.coalesce(complete, F.lit(False))).join(places, sha)


def incomplete_targets(targets: DataFrame, sha: str = "sha") -> DataFrame:
    """Per content of ``incomplete_with_paths``: number of paths, lowest id, and the id to read first (by priority, then id)."""
    first = F.min(F.struct("scan_root_priority", "path_id"))["path_id"]
    return targets.groupBy(sha).agg(F.count("*").alias("n_paths"), F.min("path_id").alias("lowest_id"), first.alias("first_path_id"))
