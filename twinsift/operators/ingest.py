"""Incremental ingest: roots, reuse planning, marking, upserts and deletes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinsift.functions.media import STATE, can_reuse
from twinsift.operators.joins import join_counted
from twinsift.plans.storage import materialize


def _base(root: Column | str) -> Column:
    return F.rtrim(F.col(root) if isinstance(root, str) else root, F.lit("\\"))


def ancestors(path: Column) -> Column:
    """The path and all folders above it, as texts without a final backslash."""
    parts = F.split(path, r"\\")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "\\"))


def uncovered_roots(roots: DataFrame, root: str = "root", priority: str = "priority") -> DataFrame:
    """Roots that do not lie under a root of smaller priority number, by a join on the folders above each."""
    other = roots.select(_base(root).alias("_a"), F.col(priority).alias("_p"))
    above = roots.select(root, priority, F.explode(ancestors(F.col(root))).alias("_a"))
    covered = above.join(other, "_a").where(F.col("_p") < F.col(priority)).select(root, priority).distinct()
    return roots.join(covered, [root, priority], "left_anti")


def distinct_roots(roots: DataFrame, root: str = "root", priority: str = "priority") -> DataFrame:
    """Roots without repeats that differ in case only; the smallest priority number stays."""
    return roots.groupBy(F.lower(root).alias("_k")).agg(F.min_by(root, priority).alias(root), F.min(priority).alias(priority)).drop("_k")


def assign_root(files: DataFrame, roots: DataFrame, path: str = "path", root: str = "root", priority: str = "priority") -> DataFrame:
    """The first configured root that holds each file, and its priority; null for files outside of all.

    A root holds a path if it is one of the folders above it or the path itself, so this
    is a join on equality, however many roots there are. It works on distinct folders,
    each with the least root above it, and folders that very many files (or folders) share are
    dealt into parts. Root columns of ``files`` are replaced.
    """
    files = files.drop(*[c for c in (root, priority) if c != path])
    least = F.struct(F.col(priority).cast("int").alias("priority"), F.col(root).alias("root"))
    best = roots.where(F.col(root).isNotNull()).groupBy(_base(root).alias("_a")).agg(F.min(least).alias("_f"))
    parts = F.split(path, r"\\")
    folder = F.when(F.size(parts) > 1, F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "\\")).otherwise("\0")
    placed = files.withColumn("_d", F.coalesce(folder, F.lit("\0")))
    folders = materialize(placed.groupBy("_d").agg(F.count("*").alias("n")), "folders")
    above = folders.select("_d", F.explode(ancestors(F.col("_d"))).alias("_a"))
    known = materialize(above.groupBy("_a").agg(F.count("*").alias("n")).join(best, "_a"), "roots")
    held = join_counted(above, known, ["_a"], ["_d"]).groupBy("_d").agg(F.min("_f").alias("_f"))
    stored = materialize(folders.join(held, "_d", "left"), "folders")
    found = join_counted(placed, stored, ["_d"], [path]).drop("_d", "n")
    # a path that is a root itself; Spark broadcasts the roots only if they are small
    own = found.join(best.select(F.col("_a").alias("_o"), F.col("_f").alias("_g")), F.col(path) == F.col("_o"), "left")
    first = F.least("_f", "_g")
    return own.withColumns({root: first["root"], priority: first["priority"]}).drop("_f", "_g", "_o")


def lowest_priority(discovered: DataFrame, path: str = "normalized_path", priority: str = "scan_root_priority") -> DataFrame:
    """One row per path, that of the smallest priority number (then of the smallest row)."""
    rest = [c for c in discovered.columns if c != path]
    return discovered.groupBy(path).agg(F.min_by(F.struct(*rest), F.struct(priority, *[c for c in rest if c != priority])).alias("_r")).select(path, "_r.*").select(*discovered.columns)


def reuse_plan(discovered: DataFrame, stored: DataFrame, contents: DataFrame | None = None, key: str = "normalized_path") -> DataFrame:
    """Each discovered file with ``action``: reuse, media (content known but incomplete), hash or new.

    ``contents`` has ``sha512`` and ``complete``.
    """
    joined = discovered.alias("n").join(stored.alias("o"), F.col(f"n.{key}") == F.col(f"o.{key}"), "left")
    reusable = can_reuse("o", "n")
    flat = joined.select("n.*", F.when(reusable, F.col("o.sha512")).alias("reused_sha512"), F.col("o.path_id").alias("stored_path_id"), reusable.alias("_reuse"))
    if contents is not None:
        known = contents.select(F.col("sha512").alias("reused_sha512"), "complete")
        flat = flat.join(known, "reused_sha512", "left")
    else:
        flat = flat.withColumn("complete", F.lit(True))
    action = F.when(F.col("_reuse") & F.coalesce("complete", F.lit(False)), "reuse").when(F.col("_reuse"), "media").when(F.col("stored_path_id").isNotNull(), "hash").otherwise("new")
    return flat.withColumn("action", action).drop("_reuse", "complete")


def plan_sources(manifest: DataFrame, local: DataFrame, remote: DataFrame, key: str = "normalized_path", columns: tuple[str, ...] = ("sha512",)) -> DataFrame:
    """Manifest rows with stored values; the local store wins over the remote one."""
    mine, theirs = local.select(key, *[F.col(c).alias(f"_l_{c}") for c in columns]), remote.select(key, *[F.col(c).alias(f"_r_{c}") for c in columns])
    joined = manifest.join(mine, key, "left").join(theirs, key, "left")
    return joined.withColumns({c: F.coalesce(f"_l_{c}", f"_r_{c}") for c in columns}).drop(*[f"_{s}_{c}" for s in "lr" for c in columns])


def mark_unseen(stored: DataFrame, seen: DataFrame, roots: DataFrame, key: str = "normalized_path") -> DataFrame:
    """Stored paths that a scan did not see: Missing under a scanned root, OutOfScope elsewhere."""
    gone = stored.join(seen.select(key), key, "left_anti")
    placed = assign_root(gone, roots, key)
    state = F.when(F.col("root").isNotNull(), STATE["Missing"]).otherwise(STATE["OutOfScope"])
    return placed.withColumn("path_state", state).withColumn("active", F.lit(False)).drop("root", "priority")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows replace old rows with the same key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def conditional_delete(rows: DataFrame, deletes: DataFrame, keys: list[str]) -> DataFrame:
    """Rows without those that match a delete in all keys (compare and delete)."""
    return rows.join(deletes.select(*keys), keys, "left_anti")


def latest_operations(ops: DataFrame, keys: list[str], sequence: str = "sequence") -> DataFrame:
    """Of each key the operation with the largest sequence (last write wins).

    An aggregate, not a window: only the latest operation of a key leaves a task.
    """
    rest = [c for c in ops.columns if c not in keys]
    return ops.groupBy(*keys).agg(F.max_by(F.struct(*rest), sequence).alias("_r")).select(*keys, "_r.*").select(*ops.columns)


def apply_operations(rows: DataFrame, ops: DataFrame, key: str, kind: str = "kind", sequence: str = "sequence", delete: str = "delete") -> DataFrame:
    """Rows after a batch of upserts and deletes; the last operation of a key counts."""
    last = latest_operations(ops, [key], sequence)
    return rows.join(last.select(key), key, "left_anti").unionByName(last.where(F.col(kind) != delete).select(*rows.columns))
