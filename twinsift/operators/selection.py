"""Which member of a group to keep, which to select, and what a selection frees. Nothing here deletes a file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinsift.functions.bits import hamming, hamming_words
from twinsift.functions.media import normalize_target

# Fixed order in which enabled policies decide.
POLICIES = ("path_priority", "highest_quality", "newest", "oldest", "largest", "smallest")


def keep_order(policies: set[str] | list[str], columns: set[str], first: Column | None = None) -> Column:
    """Struct whose smallest value in a group belongs to the member to keep.

    It holds ``first`` (if any), the keys of the enabled policies in their fixed
    order, and the path id, which decides ties.
    """
    col = lambda c: F.col(c).cast("long") if c in columns else F.lit(0).cast("long")
    rules = {
        "path_priority": [col("scan_root_priority")],
        "highest_quality": [-(col("width") * col("height")), -col("bitrate"), -col("size_bytes")],
        "newest": [-col("last_write_time_utc_ms")],
        "oldest": [col("last_write_time_utc_ms")],
        "largest": [-col("size_bytes")],
        "smallest": [col("size_bytes")],
    }
    unknown = set(policies) - set(POLICIES)
    if unknown:
        raise ValueError(f"unknown policies: {sorted(unknown)}")
    keys = ([] if first is None else [first]) + [k for p in POLICIES if p in policies for k in rules[p]]
    return F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)], F.col("path_id"))


def plan(members: DataFrame, policies: set[str] | list[str], target: str | None = None) -> DataFrame:
    """Every member with ``retained_path_id``, ``selected`` (it may be deleted) and the group's ``status``.

    With a target disk, a member elsewhere is kept if there is one, and only
    members on the target are selected. Status codes: InvalidPolicy,
    InsufficientMembers, TargetStorageNotFound, NoDeletionCandidates, Succeeded. As
    the retained member is never selected, a whole group cannot be. Repeated rows
    of one path are one file: it counts once, and each of its rows gets the file's
    decision, so a kept file is selected in none of them.

    Each group is reduced by aggregates that combine before the shuffle and joined
    back, so a group that holds a third of all rows is not gathered in one task.
    """
    goal = (target or "").strip().lower()
    on = normalize_target("storage_target_key") == F.lit(goal) if goal else F.lit(False)
    rows = members.withColumn("on_target", F.coalesce(on, F.lit(False)))
    order = keep_order(policies, set(members.columns), F.col("on_target").cast("int") if goal else None)
    hit = F.col("on_target").cast("int")
    by_file = rows.groupBy(F.col("group_id").alias("_g"), F.col("path_id").alias("_p")).agg(F.max(hit).alias("_hit"), F.min(order).alias("o"))
    groups = by_file.groupBy("_g").agg(F.count("*").alias("_members"), F.sum("_hit").alias("_matched"), F.min(F.struct("o", F.col("_hit").alias("hit"))).alias("_kept"))
    candidates = F.col("_matched") - F.col("_kept.hit") if goal else F.col("_members") - 1
    status = (
        F.when(F.lit(not policies), "InvalidPolicy").when(F.col("_members") < 2, "InsufficientMembers").when(F.lit(bool(goal)) & (F.col("_matched") == 0), "TargetStorageNotFound")
        .when(candidates == 0, "NoDeletionCandidates").otherwise("Succeeded")
    )
    groups = groups.select("_g", status.alias("status"), F.col("_kept.o.path_id").alias("_r"))
    joined = rows.join(groups, F.col("group_id").eqNullSafe(F.col("_g")))
    wanted = (F.col("path_id") != F.col("_r")) & (F.col("on_target") if goal else F.lit(True))
    joined = joined.withColumn("selected", wanted & (F.col("status") == "Succeeded"))
    return joined.withColumn("retained_path_id", F.when(F.col("status").isin("Succeeded", "NoDeletionCandidates"), F.col("_r"))).drop("_g", "_r")


def keep_one(members: DataFrame, policies: set[str] | list[str]) -> DataFrame:
    """``(group_id, retained_path_id)``: an aggregate over the sort key, so a large group is combined before the shuffle."""
    order = keep_order(policies, set(members.columns))
    return members.groupBy("group_id").agg(F.min(order).alias("_o")).select("group_id", F.col("_o.path_id").alias("retained_path_id"))


def decision(kind: Column, three_stage: bool = True, image_limit: float = 4, video_limit: float = 5) -> Column:
    """Struct (allowed, measured, distance, exclusive_limit, reason) for a candidate ``c`` beside the retained ``r``; limits are strict."""
    r, c = (lambda x: F.col(f"r.{x}")), (lambda x: F.col(f"c.{x}"))

    def out(allowed, measured=F.lit(False), distance=F.lit(0.0), limit=0.0, reason=F.lit("")) -> Column:
        return F.struct(
            (allowed if isinstance(allowed, Column) else F.lit(allowed)).alias("allowed"), measured.alias("measured"), distance.cast("double").alias("distance"),
            F.lit(float(limit)).alias("exclusive_limit"), reason.alias("reason"),
        )

    yes = F.lit(True)
    image_d, video_d = hamming(r("image_dhash"), c("image_dhash")), hamming_words(r("video_dhashes"), c("video_dhashes")) / 6
    invalid = F.coalesce((r("image_dhash") == 0) | (c("image_dhash") == 0), yes)
    image = out(True) if three_stage else F.when(invalid, out(False, limit=image_limit, reason=F.lit("image_dhash_invalid"))).otherwise(
        out(image_d < image_limit, yes, image_d, image_limit, F.when(image_d < image_limit, "").otherwise("image_distance_not_below_limit")))
    zero = F.exists(r("video_dhashes"), lambda h: h == 0) | F.exists(c("video_dhashes"), lambda h: h == 0)
    video = F.when(r("video_dhashes").isNull() | c("video_dhashes").isNull(), out(False, limit=video_limit, reason=F.lit("video_dhash_missing"))).when(
        zero, out(False, limit=video_limit, reason=F.lit("video_dhash_zero_frame"))).otherwise(
        out(video_d < video_limit, yes, video_d, video_limit, F.when(video_d < video_limit, "").otherwise("video_distance_not_below_limit")))
    return F.when(c("path_id") == r("path_id"), out(False, reason=F.lit("retained_member"))).when(kind == 0, out(True)).when(kind == 1, image).otherwise(video)


def safe_selection(members: DataFrame, retained: DataFrame, kind: Column, **limits) -> DataFrame:
    """Candidates beside their group's retained member with the decision; ``decision.allowed`` ones may be selected.

    If the retained path has repeated rows, the one that is least by its hashes and size decides.
    """
    found = members.join(retained, "group_id").where(F.col("path_id") == F.col("retained_path_id")).drop("retained_path_id")
    least = F.struct("image_dhash", "video_dhashes", "size_bytes")
    kept = found.groupBy("group_id").agg(F.min_by(F.struct(*[c for c in found.columns if c != "group_id"]), least).alias("_r")).select("group_id", "_r.*")
    pairs = members.alias("c").join(kept.alias("r"), F.col("c.group_id") == F.col("r.group_id"))
    return pairs.select("c.group_id", "c.path_id", "c.size_bytes", F.col("r.path_id").alias("retained_path_id"), decision(kind, **limits).alias("decision"))


def recheck(selection: DataFrame, members: DataFrame, kind: Column, **limits) -> DataFrame:
    """A stored selection against the group's present members: rows that are gone or no longer allowed are left out."""
    now = safe_selection(members, selection.select("group_id", "retained_path_id").distinct(), kind, **limits)
    return selection.select("group_id", "path_id").join(now.where("decision.allowed"), ["group_id", "path_id"])


def toggle(members: DataFrame, chosen: DataFrame, policies: set[str] | list[str]) -> DataFrame:
    """Manual choice: the kept member is picked among those not chosen; a group chosen whole is left out."""
    rest = members.join(chosen.select("group_id", "path_id"), ["group_id", "path_id"], "left_anti")
    kept = keep_one(rest, policies)
    return chosen.select("group_id", "path_id").join(kept, "group_id")


def snapshot(selection: DataFrame) -> DataFrame:
    """Files, bytes and groups of a selection."""
    return selection.agg(F.count("*").alias("files"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"), F.count_distinct("group_id").alias("groups"))
