"""Reports: members, evidence, summaries, relations, skipped contents, orders and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinsift.functions.bits import unsigned_key

#: Report orders: sort columns after which the group id (unsigned) decides.
ORDERS = {
    "generated": lambda: [F.col("ordinal").asc()],
    "reclaimable_desc": lambda: [F.col("reclaimable_bytes").desc()],
    "reclaimable_asc": lambda: [F.col("reclaimable_bytes").asc()],
    "members_desc": lambda: [F.col("member_count").desc()],
    "members_asc": lambda: [F.col("member_count").asc()],
    "distance_asc": lambda: [F.col("has_average").desc(), F.col("average_distance").asc()],
    "distance_desc": lambda: [F.col("has_average").desc(), F.col("average_distance").desc()],
}
REASONS = ("InvalidImage", "MissingVideo", "ZeroVideoFrame", "UnsupportedMedia", "StructuralIo", "StructuralTimeout", "StructuralCompute")


def similar_summaries(members: DataFrame, evidence: DataFrame | None = None, root: str = "root", size: str = "size_bytes") -> DataFrame:
    """Member count, reclaimable bytes (all but the smallest) and mean evidence distance of groups of two or more."""
    out = members.groupBy(root).agg(F.count("*").alias("member_count"), F.sum(size).alias("_s"), F.min(size).alias("_m")).where("member_count >= 2")
    out = out.withColumn("reclaimable_bytes", F.col("_s") - F.col("_m")).drop("_s", "_m")
    if evidence is None:
        return out.withColumns({"has_average": F.lit(False), "average_distance": F.lit(0.0)})
    mean = evidence.groupBy(root).agg(F.avg("distance").alias("average_distance"))
    joined = out.join(mean, root, "left")
    return joined.withColumns({"has_average": F.col("average_distance").isNotNull(), "average_distance": F.coalesce("average_distance", F.lit(0.0))})


def with_ordinals(rows: DataFrame, key: Column | str, name: str = "ordinal") -> DataFrame:
    """Consecutive numbers from 0 in key order, without bringing all rows to one task.

    Rows are dealt into key ranges and numbered there; each range starts where
    the counts of the ranges before it end (one number a range goes to the driver).
    """
    from twinsift.plans.storage import materialize

    spark = rows.sparkSession
    ranged = rows.withColumn("_k", key if isinstance(key, Column) else F.col(key)).repartitionByRange("_k").sortWithinPartitions("_k").withColumn("_p", F.spark_partition_id())
    stored = materialize(ranged, "ranged")
    counts = sorted((r["_p"], r["n"]) for r in stored.groupBy("_p").agg(F.count("*").alias("n")).collect())
    starts, total = [], 0
    for p, n in counts:
        starts.append((p, total))
        total += n
    offsets = spark.createDataFrame(starts, "_p int, _s long")
    number = F.row_number().over(Window.partitionBy("_p").orderBy("_k")) - 1
    return stored.withColumn("_n", number).join(F.broadcast(offsets), "_p").withColumn(name, F.col("_n") + F.col("_s")).drop("_k", "_p", "_n", "_s")


def ordered(summaries: DataFrame, order: str, group: str = "group_id") -> DataFrame:
    """Summaries in one of the report orders; ties by the unsigned group id."""
    return summaries.orderBy(*ORDERS[order](), unsigned_key(group).asc())


def page(rows: DataFrame, offset: int, count: int, ordinal: str = "ordinal") -> DataFrame:
    """A page as a range of ordinals, which a scan can skip to."""
    return rows.where((F.col(ordinal) >= offset) & (F.col(ordinal) < offset + count))


def row_starts(summaries: DataFrame, ordinal: str = "ordinal", extra: int = 2) -> DataFrame:
    """First row of each group in a list where a group takes its members and ``extra`` rows.

    Prefix sums in ranges of ordinals; each range starts where the sums of the ranges before it
    end (one number a range goes to the driver).
    """
    from twinsift.plans.storage import materialize

    rows = summaries.withColumn("_r", (F.col("member_count") + extra).cast("long"))
    ranged = materialize(rows.repartitionByRange(ordinal).sortWithinPartitions(ordinal).withColumn("_p", F.spark_partition_id()), "ranged")
    starts, total = [], 0
    for p, n in sorted((r["_p"], r["n"]) for r in ranged.groupBy("_p").agg(F.sum("_r").alias("n")).collect()):
        starts.append((p, total))
        total += n
    offsets = summaries.sparkSession.createDataFrame(starts, "_p int, _s long")
    inner = F.coalesce(F.sum("_r").over(Window.partitionBy("_p").orderBy(ordinal).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranged.withColumn("_i", inner).join(F.broadcast(offsets), "_p").withColumn("row_start", F.col("_i") + F.col("_s")).drop("_p", "_r", "_i", "_s")


def group_at_row(starts: DataFrame, row: int, extra: int = 2) -> DataFrame:
    """The group that covers a row of the list."""
    return starts.where((F.col("row_start") <= row) & (F.lit(row) < F.col("row_start") + F.col("member_count") + extra))


def skipped_stats(skipped: DataFrame, reason: str = "reason") -> DataFrame:
    """Total and count per reason."""
    return skipped.agg(F.count("*").alias("total"), *[F.count_if(F.col(reason) == r).alias(r) for r in REASONS])


def skipped_samples(skipped: DataFrame, paths: DataFrame, sha: str = "sha", most: int = 4) -> DataFrame:
    """Skipped contents with their number of active paths and the first few by path id."""
    active = paths.where("active").join(skipped.select(sha).distinct(), sha, "left_semi")
    ranked = active.withColumn("_n", F.row_number().over(Window.partitionBy(sha).orderBy("path_id"))).where(F.col("_n") <= most)
    first = ranked.groupBy(sha).agg(F.transform(F.array_sort(F.collect_list(F.struct("path_id", "full_path"))), lambda p: p["full_path"]).alias("sample_paths"))
    counts = active.groupBy(sha).agg(F.count("*").alias("active_path_count"))
    return skipped.join(counts, sha, "left").join(first, sha, "left").withColumn("active_path_count", F.coalesce("active_path_count", F.lit(0).cast("long")))


def signature_classes(contents: DataFrame, *signature: str, sha: str = "sha") -> DataFrame:
    """Signature, its first content in digest order and its number of contents."""
    return contents.groupBy(*signature).agg(F.min(sha).alias("representative"), F.count("*").alias("contents"))


def members_of(roots: DataFrame, representatives: DataFrame, paths: DataFrame, sha: str = "sha") -> DataFrame:
    """Active paths of every group: content to representative to root, then paths. Groups of two members or more."""
    rooted = representatives.join(roots.select(F.col("id").alias("representative"), "root"), "representative").select(sha, "root")
    found = paths.where("active").join(rooted, sha)
    enough = found.groupBy("root").agg(F.count("*").alias("member_count")).where("member_count >= 2")
    return found.join(enough, "root")


def route_paths(paths: DataFrame, targets: dict[str, DataFrame], sha: str = "sha") -> dict[str, DataFrame]:
    """Active paths for several tables of contents in one pass over ``paths``.

    Each target has ``sha`` and further columns of its own. The targets' rows are
    tagged and joined with the paths together, stored once in folders by target, and
    read again as one table each: the target's columns beside those of ``paths``.
    A content of very many paths is dealt over tasks.
    """
    from twinsift.operators.joins import join_tiled
    from twinsift.plans.storage import materialize

    tagged = None
    for name, table in targets.items():
        rest = [c for c in table.columns if c != sha]
        rows = table.select(sha, F.lit(name).alias("target"), F.to_json(F.struct(*rest)).alias("_own"))
        tagged = rows if tagged is None else tagged.unionByName(rows)
    active = materialize(paths.where("active"), "active")
    met = materialize(join_tiled(active.withColumn("_p", F.xxhash64(*active.columns)), materialize(tagged, "targets").withColumn("_t", F.xxhash64("target", "_own")), [sha], "_p", "_t").drop("_p", "_t"), "routed", ["target"])
    out = {}
    for name, table in targets.items():
        own = table.drop(sha).schema
        rows = met.where(F.col("target") == name).withColumn("_own", F.from_json("_own", own))
        out[name] = rows.select(*[c for c in paths.columns], *[F.col("_own")[f.name].alias(f.name) for f in own])
    return out


def enrich_relations(relations: DataFrame, counts: DataFrame, main: DataFrame) -> DataFrame:
    """Relations with both sides' member counts and whether the neighbour is in the main report; sides without members go."""
    left = counts.select(F.col("root").alias("left_root"), F.col("member_count").alias("left_members"))
    right = counts.select(F.col("root").alias("right_root"), F.col("member_count").alias("right_members"))
    flag = main.select(F.col("root").alias("right_root")).distinct().withColumn("_m", F.lit(True))
    joined = relations.join(left, "left_root", "left").join(right, "right_root", "left").join(flag, "right_root", "left")
    kept = joined.where((F.coalesce("left_members", F.lit(0)) > 0) & (F.coalesce("right_members", F.lit(0)) > 0))
    return kept.withColumn("right_in_main_report", F.coalesce("_m", F.lit(False))).drop("_m")


def funnel(pairs: DataFrame) -> DataFrame:
    """Counts of a staged pair table with ``stage`` reached: candidate, validated, accepted."""
    return pairs.agg(
        F.count("*").alias("candidates"), F.count_if("primary_ok").alias("primary"), F.count_if("secondary_ok").alias("secondary"),
        F.count_if("structure_ok").alias("accepted"), F.count_if(~F.col("structure_ok")).alias("rejected"),
        F.count_if(F.col("low_quality") & F.col("primary_ok")).alias("low_quality_evaluated"), F.count_if(F.col("low_quality") & F.col("structure_ok")).alias("low_quality_accepted"),
    )


def outcome_counts(rows: DataFrame, outcome: str = "outcome") -> DataFrame:
    return rows.groupBy(outcome).agg(F.count("*").alias("rows"))


def files_by_disk(files: DataFrame, disk: str = "disk", path: str = "path") -> DataFrame:
    """Distinct files of each disk, counted."""
    return files.select(disk, path).distinct().groupBy(disk).agg(F.count("*").alias("files"))
