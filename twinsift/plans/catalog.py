"""Registered queries of the engine and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsift.functions import bits, gates, images, media
from twinsift.operators import backfill, cluster, exact, ingest, report, selection, similar, simjoin
from twinsift.operators.components import connected_components
from twinsift.plans import generations, tables
from twinsift.plans.report_store import MEMBERS, RELATIONS, SKIPPED, ReportStore
from twinsift.plans.selection_store import SelectionStore
from twinsift.plans.storage import dealt, intermediates, materialize
from twinsift.sources import files
from twinsift.streaming import logs, outbox

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, ctes: str = ""):
    """Register a query by its function's name, with its SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = (f"WITH {ctes} " if ctes else "") + sql
        return f

    return register


# --- exact duplicates ---------------------------------------------------------


@query("SELECT sha, count(*) AS member_count, min(path_id) AS first_id, arg_min(size_bytes, path_id) AS size_bytes, arg_min(size_bytes, path_id) * (count(*) - 1) AS reclaimable_bytes FROM paths GROUP BY sha HAVING count(*) >= 2", tables.PATHS)
def exact_groups(spark, d):
    """Groups of files with the same content (flagship)."""
    return exact.exact_groups(tables.paths(spark, d))


@query("SELECT path_id, sha, full_path, member_count FROM paths JOIN (SELECT sha, count(*) AS member_count FROM paths GROUP BY sha HAVING count(*) >= 2) AS g USING (sha)", tables.PATHS)
def exact_members(spark, d):
    p = tables.paths(spark, d)
    return exact.group_members(p, exact.exact_groups(p)).select("path_id", "sha", "full_path", "member_count")


@query("SELECT count(*) AS groups, CAST(sum(n) AS BIGINT) AS members, CAST(sum(s * (n - 1)) AS BIGINT) AS reclaimable_bytes FROM (SELECT sha, count(*) AS n, arg_min(size_bytes, path_id) AS s FROM paths GROUP BY sha HAVING count(*) >= 2) AS g", tables.PATHS)
def exact_reclaimable(spark, d):
    return exact.exact_groups(tables.paths(spark, d)).agg(F.count("*").alias("groups"), F.sum("member_count").alias("members"), F.sum("reclaimable_bytes").alias("reclaimable_bytes"))


@query("SELECT sha, content_size_bytes, media_kind FROM contents WHERE sha IN (SELECT sha FROM paths WHERE active)", tables.CONTENTS)
def active_semi(spark, d):
    return exact.active_semi(tables.contents(spark, d), tables.paths(spark, d)).select("sha", "content_size_bytes", "media_kind")


@query("SELECT path_id, sha, media_kind FROM paths LEFT JOIN contents USING (sha)", tables.CONTENTS)
def paths_contents_join(spark, d):
    found, _ = exact.join_contents(tables.paths(spark, d), tables.contents(spark, d))
    return found.select("path_id", "sha", "media_kind")


@query("SELECT count(*) AS total, count(*) FILTER (WHERE image_dhash IS NOT NULL AND image_pdq_quality IS NOT NULL) AS complete, count(*) - count(*) FILTER (WHERE image_dhash IS NOT NULL AND image_pdq_quality IS NOT NULL) AS incomplete FROM contents WHERE media_kind = 1", tables.CONTENTS)
def feature_completeness(spark, d):
    images_only = tables.contents(spark, d).where("media_kind = 1")
    return exact.completeness(images_only, F.col("image_dhash").isNotNull() & F.col("image_pdq_quality").isNotNull())


@query("SELECT sha, count(*) AS n_paths, min(path_id) AS lowest_id, arg_min(path_id, scan_root_priority * 100000000 + path_id) AS first_path_id FROM paths JOIN contents USING (sha) WHERE active AND (image_dhash IS NULL OR image_pdq_quality IS NULL) GROUP BY sha", tables.CONTENTS)
def incomplete_targets(spark, d):
    ok = F.col("image_dhash").isNotNull() & F.col("image_pdq_quality").isNotNull()
    return exact.incomplete_targets(exact.incomplete_with_paths(tables.contents(spark, d), tables.paths(spark, d), ok))


@query("SELECT count(*) AS total, count(*) FILTER (WHERE complete) AS complete, count(*) FILTER (WHERE NOT complete) AS incomplete FROM featured WHERE media_kind = 1 AND sha IN (SELECT sha FROM paths WHERE active)", tables.FEATURED)
def image_completeness(spark, d):
    """Active images with all features in both algorithm versions."""
    c = exact.active_semi(tables.featured(spark, d), tables.paths(spark, d)).where("media_kind = 1")
    return exact.completeness(c, media.image_features_complete())


@query("SELECT sha, missing FROM featured WHERE missing <> ''", tables.FEATURED)
def missing_features(spark, d):
    """What each content lacks of image features, by all six conditions."""
    c = tables.featured(spark, d).withColumn("missing", media.missing_features("2")).where(F.size("missing") > 0)
    return c.select("sha", F.array_join("missing", ",").alias("missing"))


_PAIR_SUM = " + ".join(f"CAST(bit_count(xor(video_dhashes[{i + 1}], video_dhashes[{j + 1}])) AS INTEGER)" for i in range(6) for j in range(i + 1, 6))


@query(f"""SELECT sha, coalesce(CASE media_kind WHEN 1 THEN present_version AND coalesce(image_dhash, 0) <> 0 WHEN 2 THEN present_version AND NOT list_contains(video_dhashes, 0) AND video_duration_ms > 0 WHEN 3 THEN present_version ELSE true END, false) AS media_complete,
    CASE media_kind WHEN 1 THEN complete WHEN 2 THEN video_dhashes IS NOT NULL AND NOT list_contains(video_dhashes, 0) AND content_size_bytes % 17 <> 0 AND {_PAIR_SUM} >= 75 ELSE false END AS usable FROM featured""", tables.FEATURED)
def usable_visual(spark, d):
    """Whether all that is stored for a kind of media is there, and whether a content takes part in similarity."""
    return tables.featured(spark, d).select("sha", media.media_complete("2").alias("media_complete"), media.is_usable_visual().alias("usable"))


_ATTEMPTS = tables.FEATURED + """,
attempts AS (SELECT sha, scan_root_priority AS p, path_id, path_id // 10 % 4 AS status FROM paths JOIN featured USING (sha) WHERE active AND media_kind = 1 AND missing <> ''),
outcomes AS (SELECT sha, CASE WHEN count(*) FILTER (WHERE status = 0) > 0 THEN 'completed' WHEN count(*) FILTER (WHERE status <> 2) = 0 THEN 'no_readable_path' WHEN count(*) FILTER (WHERE status = 1) > 0 THEN 'timeout' ELSE 'decode_failed' END AS outcome,
    arg_min(path_id, p * 1000000000000 + path_id) FILTER (WHERE status = 0) AS path_id FROM attempts GROUP BY sha)"""


def _backfilled(spark, d):
    """Two batches of a backfill, the second over what the first left; returns its folder and the type of its rows."""
    import uuid

    base = f"{intermediates(spark)}/backfill-{uuid.uuid4().hex}"
    wanted = backfill.targets(tables.featured(spark, d).where("media_kind = 1").select("sha", media.missing_features("2").alias("missing")), tables.paths(spark, d), F.col("missing"))
    status = F.element_at(F.array(*[F.lit(s) for s in (backfill.OK, backfill.TIMEOUT, backfill.UNREADABLE, backfill.DECODE)]), (F.floor(F.col("path_id") / 10) % 4 + 1).cast("int"))
    tried = materialize(wanted.withColumn("status", status).withColumn("features", F.struct(F.col("path_id").alias("image_pdq_quality"))), "attempts")
    schema = "sha string, path_id long, features struct<image_pdq_quality:long>, outcome string"
    backfill.save_batch(base, 0, backfill.outcomes(tried.where("sha < '8'")))
    rest = backfill.pending(tried, backfill.saved(spark, base, schema)).where("sha >= '8'")
    backfill.save_batch(base, 1, backfill.outcomes(rest))
    return base, schema


@query("SELECT sha, outcome, path_id, path_id AS image_pdq_quality FROM outcomes", _ATTEMPTS)
def feature_backfill(spark, d):
    """Outcome of each incomplete active image, and the features of its first path that could be read."""
    return backfill.saved(spark, *_backfilled(spark, d)).select("sha", "outcome", "path_id", "features.image_pdq_quality")


@query("""SELECT CASE WHEN sha < '8' THEN 0 ELSE 1 END AS batch, max(sha) AS last_sha, count(*) AS processed, count(*) FILTER (WHERE outcome <> 'completed') AS failed, count(*) FILTER (WHERE outcome = 'completed') AS completed,
    count(*) FILTER (WHERE outcome = 'no_readable_path') AS no_readable_path, count(*) FILTER (WHERE outcome = 'timeout') AS timeout, count(*) FILTER (WHERE outcome = 'decode_failed') AS decode_failed FROM outcomes GROUP BY 1""", _ATTEMPTS)
def backfill_checkpoints(spark, d):
    return backfill.checkpoints(spark, _backfilled(spark, d)[0])


@query("SELECT count(DISTINCT sha) AS contents FROM paths WHERE active", tables.PATHS)
def active_distinct(spark, d):
    return files.active_paths(tables.paths(spark, d)).select("sha").distinct().agg(F.count("*").alias("contents"))


@query("SELECT path_id, sha FROM paths WHERE active", tables.PATHS)
def active_paths(spark, d):
    return files.active_paths(tables.paths(spark, d)).select("path_id", "sha")


@query("SELECT sha, media_kind FROM contents WHERE media_kind IN (1, 2) AND sha IN (SELECT sha FROM paths WHERE active)", tables.CONTENTS)
def visual_contents(spark, d):
    return files.visual_contents(tables.contents(spark, d), tables.paths(spark, d), "sha").select("sha", "media_kind")


@query("SELECT path_id, sha FROM paths WHERE full_path IN (SELECT full_path FROM paths WHERE path_id % 17 = 0)", tables.PATHS)
def path_lookup(spark, d):
    p = tables.paths(spark, d)
    return files.lookup(p, p.where("path_id % 17 = 0"), "full_path").select("path_id", "sha")


@query("SELECT path_id, full_path FROM paths WHERE starts_with(full_path, 'D:/src1/')", tables.PATHS)
def prefix_scan(spark, d):
    return files.prefix_scan(tables.paths(spark, d), "D:/src1/", "full_path").select("path_id", "full_path")


# --- files, roots, incremental ingest ---------------------------------------------


@query("""SELECT ext, CASE WHEN ext IN ('.jpg', '.png') THEN 1 WHEN ext IN ('.mp4', '.mkv', '.webm') THEN 2 WHEN ext = '.flac' THEN 3 ELSE 0 END AS media_kind, count(*) AS n
    FROM (SELECT regexp_extract(lower(full_path), '(\\.[^.\\\\/]+)$', 1) AS ext FROM paths) AS x GROUP BY ALL""", tables.PATHS)
def classify_media(spark, d):
    p = tables.paths(spark, d).select(media.extension("full_path").alias("ext"))
    return p.select("ext", media.classify_media("ext").alias("media_kind")).groupBy("ext", "media_kind").agg(F.count("*").alias("n"))


@query("SELECT path_id, lower(replace(full_path, '/', '\\')) AS normalized_path, sha256(lower(replace(full_path, '/', '\\'))) AS path_hash FROM paths", tables.PATHS)
def normalized_paths(spark, d):
    return tables.paths(spark, d).select("path_id", media.normalize_path("full_path").alias("normalized_path"), media.path_hash("full_path").alias("path_hash"))


@query("SELECT path_id FROM (SELECT path_id, lower(replace(full_path, '/', '\\')) AS p FROM paths) AS x WHERE p = 'd:\\src1' OR starts_with(p, 'd:\\src1\\')", tables.PATHS)
def under_root_filter(spark, d):
    return tables.paths(spark, d).where(media.under_root(media.normalize_path("full_path"), F.lit("d:\\src1\\"))).select("path_id")


_ROOTS = [("d:\\src1", 1), ("d:\\src1\\en", 0), ("d:\\src2\\de", 2), ("d:\\src2", 3), ("D:\\SRC1", 4), ("d:\\src1\\fr", 5)]
_ROOTS_SQL = "roots(root, priority) AS (VALUES " + ", ".join(f"('{r}', {p})" for r, p in _ROOTS) + ")"


def _roots(spark):
    return spark.createDataFrame(_ROOTS, "root string, priority int")


@query("""SELECT path_id, root, priority FROM (SELECT path_id, root, priority, row_number() OVER (PARTITION BY path_id ORDER BY priority, root) AS k
    FROM (SELECT path_id, lower(replace(full_path, '/', '\\')) AS p FROM paths) AS x LEFT JOIN roots ON p = root OR starts_with(p, root || '\\')) AS y WHERE k = 1""", tables.PATHS + ", " + _ROOTS_SQL)
def root_assignment(spark, d):
    p = tables.paths(spark, d).select("path_id", media.normalize_path("full_path").alias("path"))
    return ingest.assign_root(p, _roots(spark)).select("path_id", "root", "priority")


_FOLDERS_SQL = r"""roots AS (SELECT 'd:\' || source AS root, min(doc_id) % 7 AS priority FROM documents GROUP BY source
    UNION ALL SELECT 'd:\' || source || '\' || lang, min(doc_id) % 5 FROM documents GROUP BY source, lang)"""


def _folders(spark, d):
    """Folders of the documents, by source and by source and language, with a priority from their first document."""
    t = tables.table(spark, d, "documents")
    upper = t.groupBy("source").agg((F.min("doc_id") % 7).alias("priority")).select(F.concat(F.lit("d:\\"), "source").alias("root"), "priority")
    return upper.unionByName(t.groupBy("source", "lang").agg((F.min("doc_id") % 5).alias("priority")).select(F.concat(F.lit("d:\\"), "source", F.lit("\\"), "lang").alias("root"), "priority"))


@query("SELECT root, priority FROM roots AS r WHERE NOT EXISTS (SELECT 1 FROM roots AS o WHERE o.priority < r.priority AND (r.root = o.root OR starts_with(r.root, o.root || '\\')))", _FOLDERS_SQL)
def uncovered_roots(spark, d):
    """Folders of the documents as roots: those that lie under no root of smaller priority."""
    return ingest.uncovered_roots(_folders(spark, d))


@query("SELECT arg_min(root, priority) AS root, min(priority) AS priority FROM (SELECT CASE WHEN priority % 2 = 0 THEN upper(root) ELSE root END AS root, priority FROM roots UNION ALL SELECT root, priority + 1000000 FROM roots) AS r GROUP BY lower(root)", _FOLDERS_SQL)
def distinct_roots(spark, d):
    """Folders of the documents named twice, in upper and lower case: the one of smaller priority stays."""
    r = _folders(spark, d)
    named = r.select(F.when(F.col("priority") % 2 == 0, F.upper("root")).otherwise(F.col("root")).alias("root"), "priority").union(r.select("root", F.col("priority") + 1_000_000))
    return ingest.distinct_roots(named.toDF("root", "priority")).select("root", "priority")


def _discovered(spark, d):
    """Files of a new scan: as stored, but every seventh has another size and every eleventh is new."""
    p = tables.paths(spark, d).where("path_id % 13 <> 0")
    return p.select(
        F.when(F.col("path_id") % 11 == 0, F.concat("full_path", F.lit(".new"))).otherwise(F.col("full_path")).alias("normalized_path"),
        (F.col("size_bytes") + (F.col("path_id") % 7 == 0).cast("long")).alias("size_bytes"), "last_write_time_utc_ms", F.lit(1).alias("volume_serial"),
        F.lit(0).alias("file_id_high"), F.col("path_id").alias("file_id_low"),
    )


def _stored(spark, d):
    return tables.paths(spark, d).select(
        "path_id", F.col("full_path").alias("normalized_path"), "size_bytes", "last_write_time_utc_ms", F.lit(1).alias("volume_serial"), F.lit(0).alias("file_id_high"),
        F.col("path_id").alias("file_id_low"), F.col("sha").alias("sha512"), "scan_root_priority", "path_state", "active",
    )


_DISCOVERED = tables.CONTENTS + """,
discovered AS (SELECT CASE WHEN path_id % 11 = 0 THEN full_path || '.new' ELSE full_path END AS np, size_bytes + CASE WHEN path_id % 7 = 0 THEN 1 ELSE 0 END AS size, path_id AS fid FROM paths WHERE path_id % 13 <> 0)"""


@query("""SELECT np AS normalized_path, CASE WHEN ok AND complete THEN 'reuse' WHEN ok THEN 'media' WHEN path_id IS NOT NULL THEN 'hash' ELSE 'new' END AS action
    FROM (SELECT np, path_id, path_id IS NOT NULL AND size = size_bytes AND fid = path_id AND fid <> 0 AS ok, coalesce(image_dhash IS NOT NULL, false) AS complete
          FROM discovered LEFT JOIN paths ON np = full_path LEFT JOIN contents USING (sha)) AS x""", _DISCOVERED)
def reuse_plan(spark, d):
    known = tables.contents(spark, d).select(F.col("sha").alias("sha512"), F.col("image_dhash").isNotNull().alias("complete"))
    return ingest.reuse_plan(_discovered(spark, d), _stored(spark, d), known).select("normalized_path", "action")


@query("SELECT path_id, CASE WHEN starts_with(full_path, 'D:/src1/') OR starts_with(full_path, 'D:/src2/') THEN 4 ELSE 6 END AS path_state FROM paths WHERE full_path NOT IN (SELECT np FROM discovered)", _DISCOVERED)
def unseen_paths(spark, d):
    stored = _stored(spark, d).withColumn("normalized_path", media.normalize_path("normalized_path"))
    seen = _discovered(spark, d).select(media.normalize_path("normalized_path").alias("normalized_path"))
    roots = spark.createDataFrame([("d:\\src1", 0), ("d:\\src2", 1)], "root string, priority int")
    return ingest.mark_unseen(stored, seen, roots).select("path_id", "path_state")


@query("SELECT full_path, CASE WHEN path_id % 2 = 0 THEN sha WHEN path_id % 3 = 0 THEN 'r' || sha END AS sha FROM paths", tables.PATHS)
def plan_sources(spark, d):
    p = tables.paths(spark, d)
    local = p.where("path_id % 2 = 0").select("full_path", "sha")
    remote = p.where("path_id % 3 = 0").select("full_path", F.concat(F.lit("r"), "sha").alias("sha"))
    return ingest.plan_sources(p.select("full_path"), local, remote, "full_path", ("sha",))


@query("SELECT sha, min(scan_root_priority) AS scan_root_priority, arg_min(path_id, scan_root_priority * 100000000 + path_id) AS path_id FROM paths GROUP BY sha", tables.PATHS)
def lowest_priority_path(spark, d):
    p = tables.paths(spark, d).select("sha", "scan_root_priority", "path_id")
    return ingest.lowest_priority(p, "sha")


@query("SELECT path_id, sha, size_bytes FROM paths WHERE path_id % 4 <> 0 UNION ALL SELECT path_id, 'new', size_bytes + 1 FROM paths WHERE path_id % 4 = 0 UNION ALL SELECT path_id + 100000000, 'new', 1 FROM paths WHERE path_id % 100 = 0", tables.PATHS)
def path_upsert(spark, d):
    p = tables.paths(spark, d).select("path_id", "sha", "size_bytes")
    new = p.where("path_id % 4 = 0").select("path_id", F.lit("new").alias("sha"), F.col("size_bytes") + 1)
    fresh = p.where("path_id % 100 = 0").select(F.col("path_id") + 100_000_000, F.lit("new"), F.lit(1).cast("long"))
    return ingest.upsert(p, new.union(fresh).toDF("path_id", "sha", "size_bytes"), "path_id")


@query("SELECT path_id, sha FROM paths WHERE path_id % 6 <> 0", tables.PATHS)
def path_conditional_delete(spark, d):
    p = tables.paths(spark, d).select("path_id", "sha")
    deletes = p.where("path_id % 6 = 0").unionByName(p.where("path_id % 5 = 0 AND path_id % 6 <> 0").withColumn("sha", F.lit("other")))
    return ingest.conditional_delete(p, deletes, ["path_id", "sha"])


@query("SELECT key, payload FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY sequence DESC) AS k FROM operations) AS x WHERE k = 1 AND kind <> 'delete'", tables.OPERATIONS)
def apply_operations(spark, d):
    ops = tables.operations(spark, d)
    old = ops.select("key", F.lit("old").alias("payload")).distinct()
    return ingest.apply_operations(old, ops, "key")


@query("SELECT storage_target_key AS disk, count(DISTINCT full_path) AS files FROM paths GROUP BY storage_target_key", tables.PATHS)
def files_by_disk(spark, d):
    return report.files_by_disk(tables.paths(spark, d).select(F.col("storage_target_key").alias("disk"), F.col("full_path").alias("path")))


def _manifest(spark, d):
    """Manifest of all paths, written and read again."""
    import uuid

    folder = f"{intermediates(spark)}/manifest-{uuid.uuid4().hex}"
    files.write_manifest(tables.paths(spark, d).select(F.col("full_path").alias("path"), "storage_target_key", "size_bytes"), folder)
    return files.read_manifest(spark, folder)


@query("SELECT storage_target_key, count(*) AS files, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM paths GROUP BY storage_target_key", tables.PATHS)
def manifest_round_trip(spark, d):
    """JSON-lines manifest of all paths by disk, written and read again."""
    return _manifest(spark, d).groupBy("storage_target_key").agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"))


# --- visual rules -------------------------------------------------------------


@query("""SELECT media_kind, CASE WHEN media_kind = 1 THEN CASE WHEN image_dhash IS NOT NULL AND image_dhash <> 0 THEN 'Valid' ELSE 'InvalidImage' END
    WHEN media_kind = 2 THEN CASE WHEN video_dhashes IS NULL THEN 'MissingVideo' WHEN list_contains(video_dhashes, 0) THEN 'ZeroVideoFrame' ELSE 'Valid' END ELSE 'UnsupportedMedia' END AS status, count(*) AS n FROM contents GROUP BY ALL""", tables.CONTENTS)
def visual_status(spark, d):
    return tables.contents(spark, d).groupBy("media_kind", media.visual_status().alias("status")).agg(F.count("*").alias("n"))


@query(f"SELECT sha, {_PAIR_SUM} AS frame_sum, {_PAIR_SUM} < 75 AS static_visual FROM contents WHERE video_dhashes IS NOT NULL", tables.CONTENTS)
def static_visual(spark, d):
    c = tables.contents(spark, d).where("video_dhashes IS NOT NULL")
    return c.select("sha", media.pairwise_frame_sum("video_dhashes").alias("frame_sum"), media.is_static("video_dhashes").alias("static_visual"))


@query("SELECT sha, (width * 100000 + height // 2) // height AS grade FROM contents", tables.CONTENTS)
def aspect_grades(spark, d):
    return tables.contents(spark, d).select("sha", media.aspect_grade("width", "height").alias("grade"))


_PAIRED = "FROM contents AS l JOIN contents AS r ON l.content_size_bytes = r.content_size_bytes AND l.sha < r.sha"


def _pairs(spark, d):
    c = tables.contents(spark, d)
    return c.alias("l").join(c.alias("r"), (F.col("l.content_size_bytes") == F.col("r.content_size_bytes")) & (F.col("l.sha") < F.col("r.sha")))


@query("""SELECT a.id AS left_id, b.id AS right_id, abs(a.width * b.height - b.width * a.height) * 100 <= 12 * greatest(a.width * b.height, b.width * a.height) AS compatible
    FROM shapes AS a JOIN shapes AS b ON a.id < b.id""", tables.CONTENTS + ", shapes AS (SELECT width * 10000 + height AS id, width, height FROM contents GROUP BY width, height)")
def aspect_compatible(spark, d):
    shapes = tables.contents(spark, d).select("width", "height").distinct().withColumn("id", F.col("width") * 10000 + F.col("height"))  # at most 13 x 7 shapes
    l, r = shapes.alias("a"), F.broadcast(shapes).alias("b")
    ok = media.aspect_compatible("a.width", "a.height", "b.width", "b.height", 12)
    return l.join(r, F.col("a.id") < F.col("b.id")).select(F.col("a.id").alias("left_id"), F.col("b.id").alias("right_id"), ok.alias("compatible"))


@query(f"SELECT l.sha AS left_sha, r.sha AS right_sha, CASE WHEN coalesce(l.image_pdq_quality >= 50 AND r.image_pdq_quality >= 50, false) THEN 31 ELSE 24 END AS pdq_max {_PAIRED}", tables.CONTENTS)
def threshold_profile(spark, d):
    low = gates.is_low_quality("l.image_pdq_quality", "r.image_pdq_quality")
    return _pairs(spark, d).select(F.col("l.sha").alias("left_sha"), F.col("r.sha").alias("right_sha"), gates.limit("pdq_max", low).alias("pdq_max"))


def _featured(spark, d):
    """Signatures with image columns: shape by label, quality by id, a dHash of 16 bits."""
    s = tables.signatures(spark, d)
    return s.select("id", F.col("words").alias("image_pdq"), F.col("w16").alias("image_dhash"), (F.col("id") % 101).cast("int").alias("image_pdq_quality"), F.lit(1600).alias("width"), (F.lit(900) + F.col("id") % 3 * 4).alias("height"), "label")


_ROUTED_SQL = """
featured AS (SELECT *, id % 101 AS q, 900 + id % 3 * 4 AS h FROM signatures),
pairs AS (SELECT a.id AS left_id, b.id AS right_id, abs(b.h - a.h) * 1600 * 100 <= greatest(1600 * b.h, 1600 * a.h) AS aspect, a.q >= 50 AND b.q >= 50 AS std,
    CAST(bit_count(xor(a.w0, b.w0)) + bit_count(xor(a.w1, b.w1)) + bit_count(xor(a.w2, b.w2)) + bit_count(xor(a.w3, b.w3)) AS INTEGER) AS pdq, CAST(bit_count(xor(a.w16, b.w16)) AS INTEGER) AS dh
    FROM featured AS a JOIN featured AS b ON a.id < b.id AND a.label = b.label)"""


@query("""SELECT left_id, right_id, CASE WHEN pdq <= CASE WHEN std THEN 20 ELSE 18 END THEN 'Pdq' ELSE 'DHashFallback' END AS route FROM pairs
    WHERE aspect AND (pdq <= CASE WHEN std THEN 20 ELSE 18 END OR dh <= CASE WHEN std THEN 4 ELSE 2 END)""", tables.SIGNATURES + "," + _ROUTED_SQL)
def primary_route(spark, d):
    own = gates.Gates(gates.Profile(pdq_max=20), gates.Profile(18, 2, 8, 14, 2, 6, 850_000, 955_000, 930_000, 875_000))
    f = _featured(spark, d)
    pairs = f.alias("l").join(f.alias("r"), (F.col("l.label") == F.col("r.label")) & (F.col("l.id") < F.col("r.id")))
    return pairs.select(F.col("l.id").alias("left_id"), F.col("r.id").alias("right_id"), gates.primary_route("l", "r", own).alias("route")).where("route IS NOT NULL")


def _tiles(c: str):
    return F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: (F.col(c) * (i + 3)) % 31)


@query("""SELECT left_id, right_id, len(list_filter(ds, lambda x: x <= 10)) >= 12 AND list_sum(list_sort(ds)[1:12]) <= 8 * 12 AS accepted, CAST(len(list_filter(ds, lambda x: x <= 2)) AS INTEGER) AS close_tiles, CAST(list_sum(list_sort(ds)[1:12]) AS INTEGER) AS trimmed_sum
    FROM (SELECT a.id AS left_id, b.id AS right_id, list_transform(range(0, 16), lambda i: CAST(bit_count(xor((a.id * (i + 3)) % 31, (b.id * (i + 3)) % 31)) AS INTEGER)) AS ds FROM signatures AS a JOIN signatures AS b ON b.id = a.id + 1) AS x""", tables.SIGNATURES)
def zoned_gate(spark, d):
    s = tables.signatures(spark, d).select("id", _tiles("id").alias("tiles"))
    n = s.select((F.col("id") - 1).alias("id"), F.col("id").alias("right_id"), F.col("tiles").alias("right_tiles"))
    found = s.join(n, "id").withColumn("z", gates.zoned_evidence("tiles", "right_tiles", F.lit(False)))
    close = F.size(F.filter(bits.frame_distances("tiles", "right_tiles"), lambda x: x <= 2))
    return found.select(F.col("id").alias("left_id"), "right_id", "z.accepted", close.alias("close_tiles"), "z.trimmed_sum")


# --- Hamming joins ---------------------------------------------------------------

_NEAR = "SELECT a.id AS left_id, b.id AS right_id, CAST(bit_count(xor(a.w16, b.w16)) AS INTEGER) AS distance FROM signatures AS a JOIN signatures AS b ON a.id < b.id AND bit_count(xor(a.w16, b.w16)) <= {}"


@query(_NEAR.format(2), tables.SIGNATURES)
def hamming_blocked_e0(spark, d):
    return simjoin.hamming_pairs(tables.signatures(spark, d), "id", "w16", 2, bits=16)


@query(_NEAR.format(3), tables.SIGNATURES)
def hamming_blocked_e1(spark, d):
    return simjoin.hamming_pairs(tables.signatures(spark, d), "id", "w16", 3, bits=16, parts=2)


@query("""SELECT * FROM (SELECT a.id AS left_id, b.id AS right_id, CAST(bit_count(xor(a.w0, b.w0)) + bit_count(xor(a.w1, b.w1)) + bit_count(xor(a.w2, b.w2)) + bit_count(xor(a.w3, b.w3)) AS INTEGER) AS distance
    FROM signatures AS a JOIN signatures AS b ON a.id < b.id) AS x WHERE distance <= 16""", tables.SIGNATURES)
def hamming_pairs_wide(spark, d):
    """Four words, low 16 bits used: packed into one 64-bit word and joined in nine segments."""
    s = tables.signatures(spark, d)
    word = F.get("words", F.lit(0))
    for k in (1, 2, 3):
        word = word.bitwiseOR(F.shiftleft(F.get("words", F.lit(k)), 16 * k))
    return simjoin.hamming_pairs(s.withColumn("w64", word), "id", "w64", 16, bits=64, parts=9)


_CLASSES = "classes AS (SELECT l_partkey % 4096 AS w, min(l_orderkey) AS rep FROM lineitem GROUP BY 1)"


@query("SELECT least(a.rep, b.rep) AS left_id, greatest(a.rep, b.rep) AS right_id, CAST(bit_count(xor(a.w, b.w)) AS INTEGER) AS distance FROM classes AS a JOIN classes AS b ON a.rep < b.rep AND bit_count(xor(a.w, b.w)) <= 1", _CLASSES)
def hamming_class_pairs(spark, d):
    """Pairs between classes of equal words; repeated words never meet as pairs."""
    li = tables.table(spark, d, "lineitem").select("l_orderkey", (F.col("l_partkey") % 4096).alias("w"))
    return simjoin.hamming_classes(li, "l_orderkey", "w", 1, bits=12)[0]


@query("SELECT l_orderkey AS id, rep FROM lineitem JOIN classes ON w = l_partkey % 4096", _CLASSES)
def hamming_class_members(spark, d):
    li = tables.table(spark, d, "lineitem").select("l_orderkey", (F.col("l_partkey") % 4096).alias("w"))
    return simjoin.hamming_classes(li, "l_orderkey", "w", 1, bits=12)[1]


_FRAME_SUM = " + ".join(f"8 * CAST(bit_count(xor(a.f{k}, b.f{k})) AS INTEGER)" for k in range(6))


@query(f"""SELECT * FROM (SELECT a.id AS left_id, b.id AS right_id, CAST({_FRAME_SUM} AS INTEGER) AS total_distance, abs(a.ms - b.ms) AS duration_difference
    FROM signatures AS a JOIN signatures AS b ON a.id < b.id) AS x WHERE total_distance <= 90 AND duration_difference <= 2000""", tables.SIGNATURES)
def video_band_join(spark, d):
    return simjoin.video_pairs(tables.signatures(spark, d), "id", "frames", "ms", max_average=15)


_VIDEOS = "videos AS (SELECT l_partkey % 64 * 72340172838076673 AS f, l_suppkey % 3 * 1500 AS ms, min(l_orderkey * 10 + l_linenumber) AS rep FROM lineitem GROUP BY 1, 2)"


def _videos(spark, d):
    """Line items as videos of few different frames and durations: all of them are copies of a few."""
    frame = F.col("l_partkey") % 64 * 0x0101010101010101
    return tables.table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long").alias("id"), F.array(*[frame] * 6).alias("frames"), (F.col("l_suppkey") % 3 * 1500).alias("ms"))


@query("""SELECT least(a.rep, b.rep) AS left_id, greatest(a.rep, b.rep) AS right_id, CAST(6 * bit_count(xor(a.f, b.f)) AS INTEGER) AS total_distance, CAST(abs(a.ms - b.ms) AS BIGINT) AS duration_difference
    FROM videos AS a JOIN videos AS b ON a.rep < b.rep AND 6 * bit_count(xor(a.f, b.f)) <= 60 AND abs(a.ms - b.ms) <= 2000""", _VIDEOS)
def video_class_pairs(spark, d):
    """Pairs between classes of equal videos; copies never meet as pairs."""
    return simjoin.video_classes(_videos(spark, d), "id", "frames", "ms", max_average=10)[0]


@query("SELECT CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS id, CAST(rep AS BIGINT) AS rep FROM lineitem JOIN videos ON f = l_partkey % 64 * 72340172838076673 AND ms = l_suppkey % 3 * 1500", _VIDEOS)
def video_class_members(spark, d):
    return simjoin.video_classes(_videos(spark, d), "id", "frames", "ms", max_average=10)[1]


@query("SELECT w16, min(id) AS representative, count(*) AS contents FROM signatures GROUP BY w16", tables.SIGNATURES)
def signature_compress(spark, d):
    return report.signature_classes(tables.signatures(spark, d), "w16", sha="id")


@query("SELECT l_partkey AS signature, count(*) AS members FROM lineitem GROUP BY l_partkey HAVING count(*) > 40 OR count(*) * (count(*) - 1) > 2 * 700")
def hot_signatures(spark, d):
    li = tables.table(spark, d, "lineitem").select(F.col("l_partkey").alias("signature"))
    return simjoin.hot_signatures(li, ["signature"], 40, 700)


@query("SELECT vec_id AS id, lpad(lower(to_hex({})), 16, '0') AS word, lpad(CAST(vec_id AS VARCHAR), 20, '0') AS key FROM embeddings".format(tables.sign_sql(0, 32)))
def fixed_width_words(spark, d):
    e = tables.table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("id"), bits.hex16(tables.sign_bits(0, 32)).alias("word"), media.decimal_key("vec_id").alias("key"))


@query("""SELECT left_id, right_id, CAST(list_sum(list_transform(range(1, 9), lambda i: bit_count(xor(instr('0123456789abcdef', substr(x, i, 1)) - 1, instr('0123456789abcdef', substr(y, i, 1)) - 1)))) AS BIGINT) AS distance
    FROM (SELECT a.doc_id AS left_id, b.doc_id AS right_id, substr(md5(a.text), 1, 8) AS x, substr(md5(b.text), 1, 8) AS y FROM documents AS a JOIN documents AS b ON b.doc_id = a.doc_id + 1) AS z""")
def hamming_hex(spark, d):
    t = tables.table(spark, d, "documents").select("doc_id", F.substring(F.md5("text"), 1, 8).alias("x"))
    n = t.select((F.col("doc_id") - 1).alias("doc_id"), F.col("doc_id").alias("right_id"), F.upper("x").alias("y"))
    return t.join(n, "doc_id").select(F.col("doc_id").alias("left_id"), "right_id", bits.hamming_hex("x", "y").cast("long").alias("distance"))


def _repeated(word):
    """A 16-bit number in all four quarters of a 64-bit word."""
    out = word
    for k in (16, 32, 48):
        out = out.bitwiseOR(F.shiftleft(word, k))
    return out


def _hashed_images(spark, d):
    s = tables.signatures(spark, d)
    pdq, dhash = _repeated(F.col("w16")), _repeated(F.get("words", F.lit(1)))
    return s.select("id", F.array(pdq, pdq, pdq, pdq).alias("image_pdq"), dhash.alias("image_dhash"), (F.col("id") % 101).cast("int").alias("image_pdq_quality"), F.lit(1600).alias("width"), (900 + F.col("id") % 3 * 4).alias("height"), _tiles("id").alias("image_zoned_phashes"))


_CANDIDATES_SQL = tables.SIGNATURES + """,
featured AS (SELECT *, id % 101 AS q, 900 + id % 3 * 4 AS h FROM signatures),
pairs AS (SELECT a.id AS left_id, b.id AS right_id, abs(b.h - a.h) * 1600 * 100 <= greatest(1600 * b.h, 1600 * a.h) AS aspect, a.q >= 50 AND b.q >= 50 AS std,
    16 * CAST(bit_count(xor(a.w16, b.w16)) AS INTEGER) AS pdq, 4 * CAST(bit_count(xor(a.w1, b.w1)) AS INTEGER) AS dh FROM featured AS a JOIN featured AS b ON a.id < b.id)"""


@query("""SELECT left_id, right_id, CASE WHEN pdq <= CASE WHEN std THEN 31 ELSE 24 END THEN 'Pdq' ELSE 'DHashFallback' END AS route, pdq AS pdq_distance, dh AS dhash_distance, NOT std AS low_quality FROM pairs
    WHERE aspect AND (pdq <= CASE WHEN std THEN 31 ELSE 24 END OR dh <= CASE WHEN std THEN 4 ELSE 2 END)""", _CANDIDATES_SQL)
def image_candidates(spark, d):
    """Both routes of the primary gate, each pair once."""
    return similar.image_candidates(_hashed_images(spark, d))


@query()
def image_pipeline(spark, d):
    """From pictures (each in two brightnesses) to similarity groups: features, candidates, zoned and structural gates, clusters."""
    both = _pictures(spark, d).select((F.col("vec_id") * 2).alias("id"), "content").unionByName(_pictures(spark, d, 134).select((F.col("vec_id") * 2 + 1).alias("id"), "content"))
    pictures = materialize(both.where("id IS NOT NULL"), "pictures")
    f = materialize(images.with_features(dealt(pictures, "id", rows=images.TASK_IMAGES), plane=False), "features")
    staged, members = similar.image_edges(f, pictures)
    staged = materialize(staged, "staged")
    roots = cluster.complete_link(staged.where("structure_ok").withColumn("distance", F.col("pdq_distance")))[0]
    return similar.with_members(roots, members)


@query(f"""SELECT left_id, right_id, total_distance FROM (SELECT a.id AS left_id, b.id AS right_id, CAST({_FRAME_SUM} AS INTEGER) AS total_distance, abs(a.ms - b.ms) AS dd
    FROM usable AS a JOIN usable AS b ON a.id < b.id) AS x WHERE total_distance <= 90 AND dd <= 2000""", tables.SIGNATURES + ", usable AS (SELECT * FROM signatures WHERE " + " AND ".join(f"f{k} <> 0" for k in range(6)) + " AND " + " + ".join(f"8 * CAST(bit_count(xor(f{i}, f{j})) AS INTEGER)" for i in range(6) for j in range(i + 1, 6)) + " >= 75)")
def video_edges(spark, d):
    s = tables.signatures(spark, d).select("id", F.col("frames").alias("video_dhashes"), F.col("ms").alias("video_duration_ms"))
    return similar.video_edges(s, 15).select("left_id", "right_id", "total_distance")


# --- clustering ---------------------------------------------------------------------

_CHAIN = tables.SIGNATURES + """,
e AS (SELECT a.id AS x, b.id AS y FROM signatures AS a JOIN signatures AS b ON a.id <> b.id AND bit_count(xor(a.w16, b.w16)) <= 1),
reach(id, root) AS (SELECT x, x FROM e UNION SELECT e.y, r.root FROM reach AS r JOIN e ON e.x = r.id)"""


@query("SELECT id, min(root) AS component FROM reach GROUP BY id", "RECURSIVE " + _CHAIN)
def components(spark, d):
    """Components of representatives of equal words, then their members; words have 16 bits, so the pairs are bounded."""
    pairs, members = simjoin.hamming_classes(tables.signatures(spark, d), "id", "w16", 1, bits=16)
    roots = connected_components(pairs, "left_id", "right_id").withColumnRenamed("component", "root")
    return similar.with_members(roots, materialize(members, "members")).withColumnRenamed("root", "component")


def _near(spark, d):
    """Near classes of equal words, and their members; words have 16 bits, so the pairs of classes are bounded."""
    pairs, members = simjoin.flipped_classes(tables.signatures(spark, d), "id", "w16", 2, bits=16)
    return pairs, materialize(members, "members")


@query()
def complete_link_groups(spark, d):
    """Greedy complete-link groups of near signatures."""
    return cluster.complete_link_copies(*_near(spark, d))


@query()
def cross_relations(spark, d):
    """Edges between different groups, both ways."""
    pairs, members = _near(spark, d)
    return cluster.cross_copies(pairs, members, materialize(cluster.complete_link_copies(pairs, members), "roots"))


@query()
def similar_report(spark, d):
    """Groups of near signatures with counts, reclaimable bytes, mean distance and stable ids."""
    roots = materialize(cluster.complete_link_copies(*_near(spark, d)), "roots")
    rows = tables.signatures(spark, d).select("id", F.col("ms").alias("size_bytes"), "w16")
    m = roots.join(rows, "id")
    # a member has an edge to its root, as to all members
    evidence = m.where("id <> root").join(rows.select(F.col("id").alias("root"), F.col("w16").alias("own")), "root").select("root", bits.hamming("w16", "own").alias("distance"))
    s = report.similar_summaries(m, evidence)
    return report.with_ordinals(s, "root").withColumn("group_id", media.stable_group_id(F.col("root").cast("string"), 1))


# --- summaries, orders, pages ---------------------------------------------------


def _summaries(spark, d):
    li = tables.members(spark, d)
    return report.similar_summaries(li, li.where("bitrate % 2 = 0").select("group_id", F.col("width").alias("distance")), "group_id")


_SUMMARIES = tables.MEMBERS + """,
summaries AS (SELECT group_id, count(*) AS member_count, CAST(sum(size_bytes) - min(size_bytes) AS BIGINT) AS reclaimable_bytes, count(*) FILTER (WHERE bitrate % 2 = 0) > 0 AS has_average,
    coalesce(CAST(sum(width) FILTER (WHERE bitrate % 2 = 0) AS DOUBLE) / nullif(count(*) FILTER (WHERE bitrate % 2 = 0), 0), 0.0) AS average_distance FROM members GROUP BY group_id HAVING count(*) >= 2),
numbered AS (SELECT *, row_number() OVER (ORDER BY group_id) - 1 AS ordinal FROM summaries)"""


@query("SELECT group_id, member_count, reclaimable_bytes, has_average, round(average_distance, 6) AS average_distance FROM summaries", _SUMMARIES)
def group_summaries(spark, d):
    return _summaries(spark, d).withColumn("average_distance", F.round("average_distance", 6))


_ORDER_SQL = {
    "generated": "ordinal", "reclaimable_desc": "reclaimable_bytes DESC", "reclaimable_asc": "reclaimable_bytes", "members_desc": "member_count DESC", "members_asc": "member_count",
    "distance_asc": "has_average DESC, average_distance", "distance_desc": "has_average DESC, average_distance DESC",
}


def _sorted(order: str):
    def run(spark, d):
        s = report.with_ordinals(_summaries(spark, d), "group_id")
        return report.ordered(s, order).limit(50).select("group_id", "member_count", "reclaimable_bytes", "ordinal")

    run.__name__ = f"report_sort_{order}"
    run.__doc__ = f"First page of the report in the order {order}."
    return query(f"SELECT group_id, member_count, reclaimable_bytes, ordinal FROM numbered ORDER BY {_ORDER_SQL[order]}, group_id LIMIT 50", _SUMMARIES)(run)


for _order in report.ORDERS:
    _sorted(_order)


@query("SELECT group_id, ordinal FROM numbered WHERE ordinal >= 100 AND ordinal < 150", _SUMMARIES)
def report_page(spark, d):
    return report.page(report.with_ordinals(_summaries(spark, d), "group_id"), 100, 50).select("group_id", "ordinal")


@query("SELECT group_id, ordinal, CAST(coalesce(sum(member_count + 2) OVER (ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS row_start FROM numbered", _SUMMARIES)
def row_starts(spark, d):
    return report.row_starts(report.with_ordinals(_summaries(spark, d), "group_id")).select("group_id", "ordinal", "row_start")


@query("SELECT group_id FROM (SELECT group_id, member_count, coalesce(sum(member_count + 2) OVER (ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM numbered) AS x WHERE s <= 777 AND 777 < s + member_count + 2", _SUMMARIES)
def group_at_row(spark, d):
    return report.group_at_row(report.row_starts(report.with_ordinals(_summaries(spark, d), "group_id")), 777).select("group_id")


_SKIPPED = tables.CONTENTS + """,
skipped AS (SELECT sha, CASE WHEN media_kind = 1 THEN 'InvalidImage' WHEN video_dhashes IS NULL THEN 'MissingVideo' ELSE 'ZeroVideoFrame' END AS reason FROM contents
    WHERE (media_kind = 1 AND coalesce(image_dhash, 0) = 0) OR (media_kind = 2 AND (video_dhashes IS NULL OR list_contains(video_dhashes, 0))))"""


def _skipped(spark, d):
    return tables.contents(spark, d).withColumn("reason", media.visual_status()).where(~F.col("reason").isin("Valid", "UnsupportedMedia")).select("sha", "reason")


@query("SELECT count(*) AS total, " + ", ".join(f"count(*) FILTER (WHERE reason = '{r}') AS \"{r}\"" for r in report.REASONS) + " FROM skipped", _SKIPPED)
def skipped_stats(spark, d):
    return report.skipped_stats(_skipped(spark, d))


@query("""SELECT sha, reason, count(path_id) AS active_path_count, min(path_id) AS first_path_id FROM skipped LEFT JOIN (SELECT * FROM paths WHERE active) AS p USING (sha) GROUP BY sha, reason""", _SKIPPED)
def skipped_samples(spark, d):
    found = report.skipped_samples(_skipped(spark, d), tables.paths(spark, d))
    first = F.regexp_extract(F.get("sample_paths", F.lit(0)), r"/F(\d+)", 1)
    return found.select("sha", "reason", "active_path_count", F.when(first != "", first).cast("long").alias("first_path_id"))


@query("""SELECT sha, reason, list_aggregate(list_transform(list_sort(list(path_id))[1:4], lambda i: CAST(i AS VARCHAR)), 'string_agg', ',') AS sample_ids FROM skipped JOIN (SELECT * FROM paths WHERE active) AS p USING (sha) GROUP BY sha, reason""", _SKIPPED)
def skipped_sample_lists(spark, d):
    """All sample paths of each skipped content that has any, by the ids in their names."""
    found = report.skipped_samples(_skipped(spark, d), tables.paths(spark, d)).where("active_path_count > 0")
    ids = F.transform("sample_paths", lambda p: F.regexp_extract(p, r"/F(\d+)", 1))
    return found.select("sha", "reason", F.array_join(ids, ",").alias("sample_ids"))


@query("SELECT root, path_id, member_count FROM (SELECT w.sha, path_id, w.root, count(*) OVER (PARTITION BY w.root) AS member_count FROM (SELECT sha, min(sha) OVER (PARTITION BY content_size_bytes) AS root FROM contents) AS w JOIN paths AS p ON p.sha = w.sha WHERE active) AS x WHERE member_count >= 2", tables.CONTENTS)
def group_members(spark, d):
    """Content to representative to root, then active paths; contents of one size stand for one group."""
    c = tables.contents(spark, d)
    reps = c.join(c.groupBy("content_size_bytes").agg(F.min("sha").alias("representative")), "content_size_bytes").select("sha", "representative")
    roots = reps.select(F.col("representative").alias("id"), F.col("representative").alias("root")).distinct()
    return report.members_of(roots, reps, tables.paths(spark, d)).select("root", "path_id", "member_count")


@query("""SELECT r.lo AS left_root, r.hi AS right_root, a.n AS left_members, b.n AS right_members, r.hi % 2 = 0 AS right_in_main_report FROM (SELECT DISTINCT first AS lo, l_orderkey AS hi FROM lineitem
    JOIN (SELECT l_partkey, min(l_orderkey) AS first FROM lineitem GROUP BY 1) AS f USING (l_partkey) WHERE l_orderkey <> first) AS r
    JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 2) AS a ON a.l_orderkey = r.lo JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 2) AS b ON b.l_orderkey = r.hi""")
def enrich_relations(spark, d):
    """Relations over all line items: the first order of a part stands for it and is related to each other order."""
    li = tables.table(spark, d, "lineitem")
    first = li.groupBy("l_partkey").agg(F.min("l_orderkey").alias("left_root"))
    rel = li.join(first, "l_partkey").select("left_root", F.col("l_orderkey").alias("right_root")).where("left_root < right_root").distinct()
    counts = li.groupBy(F.col("l_orderkey").alias("root")).agg(F.count("*").alias("member_count")).where("member_count > 2")
    main = li.where("l_orderkey % 2 = 0").select(F.col("l_orderkey").alias("root"))
    return report.enrich_relations(rel, counts, main).select("left_root", "right_root", "left_members", "right_members", "right_in_main_report")


@query("""SELECT count(*) AS candidates, count(*) FILTER (WHERE o_orderkey % 2 = 0) AS "primary", count(*) FILTER (WHERE o_orderkey % 4 = 0) AS secondary, count(*) FILTER (WHERE o_orderkey % 8 = 0) AS accepted,
    count(*) FILTER (WHERE o_orderkey % 8 <> 0) AS rejected, count(*) FILTER (WHERE o_custkey % 3 = 0 AND o_orderkey % 2 = 0) AS low_quality_evaluated, count(*) FILTER (WHERE o_custkey % 3 = 0 AND o_orderkey % 8 = 0) AS low_quality_accepted FROM orders""")
def similarity_funnel(spark, d):
    o = tables.table(spark, d, "orders")
    staged = {"primary_ok": "o_orderkey % 2 = 0", "secondary_ok": "o_orderkey % 4 = 0", "structure_ok": "o_orderkey % 8 = 0", "low_quality": "o_custkey % 3 = 0"}
    return report.funnel(o.withColumns({k: F.expr(v) for k, v in staged.items()}))


@query("SELECT event_type AS outcome, count(*) AS rows FROM events GROUP BY event_type")
def outcome_counts(spark, d):
    return report.outcome_counts(tables.table(spark, d, "events").withColumnRenamed("event_type", "outcome"))


@query()
def group_ids(spark, d):
    """Stable 64-bit ids of exact groups."""
    return exact.exact_groups(tables.paths(spark, d)).select("sha", media.stable_group_id(F.col("sha")).alias("group_id"))


# --- retention and selection --------------------------------------------------

_KEEP_SQL = {
    "newest": "last_write_time_utc_ms DESC", "oldest": "last_write_time_utc_ms", "largest": "size_bytes DESC", "smallest": "size_bytes",
    "highest_quality": "width * height DESC, bitrate DESC, size_bytes DESC", "path_priority": "scan_root_priority",
}


def _keep(policy: str):
    def run(spark, d):
        return selection.keep_one(tables.members(spark, d), [policy])

    run.__name__ = f"keep_{policy}"
    run.__doc__ = f"Member to keep of every group by the policy {policy}."
    return query(f"SELECT group_id, path_id AS retained_path_id FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY {_KEEP_SQL[policy]}, path_id) AS k FROM members) AS x WHERE k = 1", tables.MEMBERS)(run)


for _policy in selection.POLICIES:
    _keep(_policy)


@query("""SELECT group_id, path_id, CASE WHEN n < 2 THEN 'InsufficientMembers' ELSE 'Succeeded' END AS status, n >= 2 AND path_id <> kept AS selected FROM members JOIN (SELECT group_id, count(DISTINCT path_id) AS n,
    arg_min(path_id, (scan_root_priority, -last_write_time_utc_ms, path_id)) AS kept FROM members GROUP BY group_id) AS g USING (group_id)""", tables.MEMBERS)
def plan_status(spark, d):
    """Plan by two policies. Repeated rows of one path are one file, in the SQL too."""
    return selection.plan(tables.members(spark, d), ["newest", "path_priority"]).select("group_id", "path_id", "status", "selected")


@query("""SELECT group_id, path_id, st AS status, st = 'Succeeded' AND k > 1 AND t = 1 AS selected FROM (SELECT *, CASE WHEN n < 2 THEN 'InsufficientMembers' WHEN m = 0 THEN 'TargetStorageNotFound'
    WHEN sum(CASE WHEN k > 1 AND t = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY group_id) = 0 THEN 'NoDeletionCandidates' ELSE 'Succeeded' END AS st FROM (SELECT *, count(*) OVER (PARTITION BY group_id) AS n,
    sum(t) OVER (PARTITION BY group_id) AS m, row_number() OVER (PARTITION BY group_id ORDER BY t, size_bytes DESC, path_id) AS k FROM (SELECT *, CASE WHEN lower(trim(storage_target_key)) = 'physicaldrive1' THEN 1 ELSE 0 END AS t FROM members) AS a) AS b) AS c""", tables.MEMBERS)
def target_disk_plan(spark, d):
    return selection.plan(tables.members(spark, d), ["largest"], "  PhysicalDrive1 ").select("group_id", "path_id", "status", "selected")


def _hashed_members(spark, d):
    return tables.members(spark, d).withColumns({"image_dhash": F.col("size_bytes") % 64, "video_dhashes": F.lit(None).cast("array<bigint>")})


_SAFE = tables.MEMBERS + """,
kept AS (SELECT group_id, path_id AS rid, size_bytes % 64 AS rh FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY size_bytes DESC, path_id) AS k FROM members) AS x WHERE k = 1),
decided AS (SELECT group_id, path_id, size_bytes, rid AS retained_path_id, CASE WHEN path_id = rid THEN 'retained_member' WHEN rh = 0 OR size_bytes % 64 = 0 THEN 'image_dhash_invalid'
    WHEN bit_count(xor(rh, size_bytes % 64)) < 3 THEN '' ELSE 'image_distance_not_below_limit' END AS reason FROM members JOIN kept USING (group_id))"""


def _safe(spark, d):
    m = _hashed_members(spark, d)
    return selection.safe_selection(m, selection.keep_one(m, ["largest"]), F.lit(1), three_stage=False, image_limit=3)


@query("SELECT group_id, path_id, retained_path_id, reason = '' AS allowed, reason FROM decided", _SAFE)
def safe_selection(spark, d):
    return _safe(spark, d).select("group_id", "path_id", "retained_path_id", "decision.allowed", "decision.reason")


@query("SELECT group_id, path_id FROM decided WHERE reason = '' AND path_id % 2 = 0", _SAFE)
def recheck_selection(spark, d):
    s = _safe(spark, d).where("decision.allowed AND path_id % 2 = 0")
    return selection.recheck(s, _hashed_members(spark, d), F.lit(1), three_stage=False, image_limit=3).select("group_id", "path_id")


@query("SELECT count(*) AS files, CAST(sum(size_bytes) AS BIGINT) AS bytes, count(DISTINCT group_id) AS groups FROM decided WHERE reason = ''", _SAFE)
def selection_snapshot(spark, d):
    return selection.snapshot(_safe(spark, d).where("decision.allowed"))


@query("SELECT group_id, path_id, retained_path_id, size_bytes FROM decided WHERE reason = '' AND group_id % 7 <> 0", _SAFE)
def selection_store(spark, d):
    """A selection saved in two batches and published, some groups emptied, and a second replacement discarded."""
    import uuid

    store = SelectionStore(spark, f"{intermediates(spark)}/{uuid.uuid4().hex}")
    chosen = materialize(_safe(spark, d).where("decision.allowed").select("group_id", "path_id", "retained_path_id", "size_bytes"), "chosen")
    first = store.begin()
    store.save(first, chosen.where("path_id % 2 = 0"))
    store.save(first, chosen.where("path_id % 2 <> 0"))
    store.publish(first)
    store.set_groups(chosen.where("group_id % 7 = 0").select("group_id").distinct(), chosen.limit(0))
    second = store.begin()
    store.save(second, chosen)
    store.discard(second)
    return store.present()


@query("""SELECT c.group_id, c.path_id, k.path_id AS retained_path_id FROM members AS c JOIN (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY size_bytes, path_id) AS k FROM members WHERE path_id % 10 > 3) AS k
    ON k.group_id = c.group_id AND k.k = 1 WHERE c.path_id % 10 <= 3""", tables.MEMBERS)
def manual_toggle(spark, d):
    m = tables.members(spark, d)
    return selection.toggle(m, m.where("path_id % 10 <= 3"), ["smallest"])


# --- generations, outbox, logs -------------------------------------------------


@query("SELECT group_id, member_count FROM summaries WHERE member_count > 3", _SUMMARIES)
def published_generation(spark, d):
    """Two generations written, the second published, the first cleaned; readers see the second."""
    import uuid

    g = generations.Generations(spark, f"{intermediates(spark)}/{uuid.uuid4().hex}", "similar")
    s = _summaries(spark, d)
    g.write(1, "summaries", s.where("member_count > 5"))
    kept = s.where("member_count > 3")
    g.write(2, "summaries", kept)
    g.publish(2, g.read("summaries", 2).count())
    g.clean()
    return g.read("summaries").select("group_id", "member_count")


@query("""SELECT kind, group_key, ordinal, value FROM (
    SELECT 'relations' AS kind, l_partkey AS group_key, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey) - 1 AS ordinal, l_orderkey AS value FROM (SELECT DISTINCT l_partkey, l_orderkey FROM lineitem) AS r
    UNION ALL SELECT 'signature_members', w16, row_number() OVER (PARTITION BY w16 ORDER BY id) - 1, id FROM signatures
    UNION ALL SELECT 'skipped', NULL, row_number() OVER (ORDER BY o_orderkey) - 1, o_orderkey FROM orders) AS x
    WHERE (kind = 'relations' AND group_key = (SELECT min(l_partkey) FROM lineitem) AND ordinal BETWEEN 2 AND 6) OR (kind = 'signature_members' AND group_key = (SELECT min(w16) FROM signatures) AND ordinal < 3) OR (kind = 'skipped' AND ordinal BETWEEN 100 AND 119)""", tables.SIGNATURES)
def report_pages(spark, d):
    """Pages of a published report: relations and signature members of a group, and skipped rows of the whole report."""
    import uuid

    store = ReportStore(spark, f"{intermediates(spark)}/{uuid.uuid4().hex}")
    relations = tables.table(spark, d, "lineitem").select("l_partkey", "l_orderkey").distinct()
    same, skipped = tables.signatures(spark, d).select("w16", "id"), tables.table(spark, d, "orders").select("o_orderkey")
    number = store.begin()
    store.save_rules(number, {"pdq_max": 31})
    store.save(number, RELATIONS, relations, ["l_orderkey"], "l_partkey")
    store.save(number, MEMBERS, same, ["id"], "w16")
    store.save(number, SKIPPED, skipped, ["o_orderkey"])
    store.publish(number)
    first = lambda name, c: store.counts(name).agg(F.min(c)).first()[0]
    shape = lambda kind, rows, group, value: rows.select(F.lit(kind).alias("kind"), group.cast("long").alias("group_key"), "ordinal", F.col(value).alias("value"))
    a = shape(RELATIONS, store.group_page(RELATIONS, "l_partkey", first(RELATIONS, "l_partkey"), 2, 5), F.col("l_partkey"), "l_orderkey")
    b = shape(MEMBERS, store.group_page(MEMBERS, "w16", first(MEMBERS, "w16"), 0, 3), F.col("w16"), "id")
    return a.unionByName(b).unionByName(shape(SKIPPED, store.page(SKIPPED, 100, 20), F.lit(None), "o_orderkey"))


@query("SELECT 'present' AS store, max(r_regionkey)::BIGINT AS schema_version FROM region UNION ALL SELECT 'empty', 0")
def schema_version(spark, d):
    r = tables.table(spark, d, "region")
    version = lambda rows, store: generations.schema_version(rows, "r_regionkey").withColumn("store", F.lit(store))
    return version(r, "present").unionByName(version(r.where("r_regionkey IS NULL"), "empty"))


@query("""SELECT event_id, CASE WHEN coalesce(lv > 1, false) OR coalesce(rv > 1, false) THEN 'RejectNewerData' WHEN NOT coalesce(lv = 1 AND rv = 1 AND lg <> 0 AND lg = rg, false) THEN 'ResetRequired' WHEN ls AND rs THEN 'ReuseReady' ELSE 'ResumeRebuild' END AS decision
    FROM (SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN least(user_id % 4, 1) + (event_id % 17 = 0)::INT END AS lv, event_id % 3 AS lg, event_type = 'click' AS ls, CASE WHEN event_id % 7 <> 0 THEN 1 END AS rv, user_id % 3 AS rg, user_id % 2 = 0 AS rs FROM events) AS x""")
def version_decision(spark, d):
    """Decisions on pairs of stores whose versions, generations and states come from the events."""
    state = lambda ready: F.when(ready, "ready").otherwise("rebuilding").alias("state")
    e, u = F.col("event_id"), F.col("user_id")
    local = F.struct((F.least(u % 4, F.lit(1)) + (e % 17 == 0).cast("int")).alias("data_version"), (e % 3).alias("generation_id"), state(F.col("event_type") == "click"))
    remote = F.struct(F.lit(1).alias("data_version"), (u % 3).alias("generation_id"), state(u % 2 == 0))
    rows = tables.table(spark, d, "events").select("event_id", F.when(e % 5 != 0, local).alias("local"), F.when(e % 7 != 0, remote).alias("remote"))
    return rows.select("event_id", generations.version_decision("local", "remote").alias("decision"))


@query("SELECT batch_scan_id, kind, key, sequence, payload FROM (SELECT *, row_number() OVER (PARTITION BY batch_scan_id, kind, key ORDER BY sequence DESC) AS k FROM operations) AS x WHERE k = 1", tables.OPERATIONS)
def outbox_latest(spark, d):
    return outbox.staged(tables.operations(spark, d), "sequence").select("batch_scan_id", "kind", "key", "sequence", "payload")


@query("SELECT batch_scan_id, kind, key, 1000 + row_number() OVER (ORDER BY batch_scan_id, key, kind) AS sequence FROM (SELECT DISTINCT batch_scan_id, kind, key FROM operations) AS x", tables.OPERATIONS)
def outbox_publish(spark, d):
    return outbox.publish(outbox.staged(tables.operations(spark, d), "sequence"), 1000).select("batch_scan_id", "kind", "key", "sequence")


@query("SELECT batch_scan_id, count(*) AS pending FROM operations GROUP BY batch_scan_id", tables.OPERATIONS)
def outbox_counts(spark, d):
    return outbox.staged_counts(tables.operations(spark, d))


@query("SELECT sequence, key, kind FROM head WHERE sequence < (SELECT coalesce(min(sequence), 9000000000) FROM head WHERE next_attempt_utc_ms > 900)", tables.OPERATIONS + ", head AS (SELECT * FROM operations ORDER BY sequence LIMIT 200)")
def outbox_due(spark, d):
    return outbox.due_batch(tables.operations(spark, d), 900, 200).select("sequence", "key", "kind")


@query("SELECT sequence, attempt_count, CAST(least(power(2, least(greatest(attempt_count - 1, 0), 6)), 300) * 1000 AS BIGINT) AS delay_ms FROM operations", tables.OPERATIONS)
def outbox_backoff(spark, d):
    return tables.operations(spark, d).select("sequence", "attempt_count", outbox.backoff_ms("attempt_count").alias("delay_ms"))


@query("SELECT key, payload FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY sequence DESC) AS k FROM operations) AS x WHERE k = 1 AND kind <> 'delete'", tables.OPERATIONS)
def outbox_stream(spark, d):
    """Operations as a stream, applied to a table in micro-batches."""
    import uuid

    base = f"{intermediates(spark)}/{uuid.uuid4().hex}"
    operation = "sequence long, kind string, key long, payload string"
    tables.operations(spark, d).select("sequence", "kind", "key", "payload").repartitionByRange(3, "sequence").write.parquet(f"{base}/in")
    stream = spark.readStream.schema(operation).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "*.parquet").parquet(f"{base}/in")
    run = outbox.run(stream, outbox.table_applier(f"{base}/out"), f"{base}/checkpoint")
    run.awaitTermination()
    if run.exception():
        raise run.exception()
    return outbox.applied_table(spark, f"{base}/out", operation).select("key", "payload")


@query("""SELECT sequence, batch_scan_id, kind, key FROM operations WHERE batch_scan_id >= 3 UNION ALL
    SELECT (SELECT max(sequence) FROM operations WHERE batch_scan_id >= 3) + row_number() OVER (ORDER BY batch_scan_id, key, kind), batch_scan_id, kind, key FROM (SELECT DISTINCT batch_scan_id, kind, key FROM operations WHERE batch_scan_id < 3) AS x""", tables.OPERATIONS)
def outbox_recover(spark, d):
    """The queue after a restart: what earlier scans left staged follows what was queued."""
    ops = tables.operations(spark, d).select("sequence", "batch_scan_id", "kind", "key")
    queue = ops.where("batch_scan_id >= 3")
    return queue.unionByName(outbox.recover(outbox.staged(ops.where("batch_scan_id < 3"), "sequence"), queue))


@query("SELECT (k - 1) // 1000 AS batch, count(*) AS operations, min(sequence) AS first_sequence, max(sequence) AS last_sequence FROM (SELECT sequence, row_number() OVER (ORDER BY sequence) AS k FROM operations) AS x GROUP BY 1", tables.OPERATIONS)
def outbox_batches(spark, d):
    """Batches of a thousand operations by sequence; the last one is the final flush."""
    made = outbox.batches(tables.operations(spark, d).select("sequence"))
    return made.groupBy("batch").agg(F.count("*").alias("operations"), F.min("sequence").alias("first_sequence"), F.max("sequence").alias("last_sequence"))


_RUNS = "runs AS (SELECT c_custkey AS scan_id, CASE WHEN c_custkey % 6 = 0 THEN 'Interrupted' ELSE [" + ", ".join(f"'{p}'" for p in outbox.PHASES) + "][c_custkey % 15 + 1] END AS phase, CASE WHEN c_custkey % 6 = 0 THEN 100000 ELSE c_custkey * 7919 % 100000 END AS updated_utc_ms FROM customer)"


@query("SELECT scan_id, phase, updated_utc_ms FROM runs WHERE phase IN (" + ", ".join(f"'{p}'" for p in outbox.RESUMABLE) + ") ORDER BY updated_utc_ms DESC, scan_id LIMIT 50", _RUNS)
def scan_runs(spark, d):
    """Checkpoint table after a restart marked lost scans as interrupted, and the newest that may be resumed."""
    c = tables.table(spark, d, "customer").select(F.col("c_custkey").alias("scan_id"))
    phase = F.element_at(F.array(*[F.lit(p) for p in outbox.PHASES]), (F.col("scan_id") % 15 + 1).cast("int"))
    runs = c.select("scan_id", phase.alias("phase"), (F.col("scan_id") * 7919 % 100_000).alias("updated_utc_ms"))
    return outbox.resumable(outbox.mark_interrupted(runs, c.where("scan_id % 6 = 0"), 100_000))


@query("""SELECT intent_id, CASE WHEN state = 'prepared' AND intent_id % 3 = 0 THEN 'drop' ELSE 'delete_mapping' END AS action FROM (SELECT user_id AS intent_id, CASE event_type WHEN 'click' THEN 'prepared' WHEN 'purchase' THEN 'done' ELSE 'file_deleted' END AS state,
    row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) AS x WHERE k = 1 AND state <> 'done'""")
def delete_recovery(spark, d):
    """Delete intents that a restart found: files still there are kept, the paths of the others go."""
    state = F.when(F.col("event_type") == "click", "prepared").when(F.col("event_type") == "purchase", "done").otherwise("file_deleted")
    log = tables.table(spark, d, "events").select(F.col("user_id").alias("intent_id"), F.col("event_id").alias("sequence"), state.alias("state"))
    return outbox.recover_deletes(outbox.delete_intents(log), log.where("intent_id % 3 = 0")).select("intent_id", "action")


def _log(spark, d):
    e = tables.table(spark, d, "events")
    return e.select(
        F.col("event_id").alias("sequence"), "ts", F.when(F.col("event_type") == "purchase", "error").otherwise("info").alias("severity"), F.concat(F.lit("task"), (F.col("user_id") % 7).cast("string")).alias("task"),
        F.col("event_type").alias("stage"), F.lit("run").alias("operation"), (F.col("user_id") % 3).cast("string").alias("subject"),
        (F.col("user_id") % 7).alias("task_id"), F.lit(0).alias("status_code"), (F.col("user_id") % 3).alias("native_error"), F.upper("event_type").alias("message"), F.lit(1).cast("long").alias("repeat_count"),
    )


_LOG = "log AS (SELECT event_id AS sequence, ts, 'task' || CAST(user_id % 7 AS VARCHAR) AS task, event_type AS stage, CAST(user_id % 3 AS VARCHAR) AS subject FROM events)"


@query("SELECT task, stage, subject, count(*) AS repeat_count, max(sequence) AS sequence FROM log GROUP BY task, stage, subject", _LOG)
def log_aggregate(spark, d):
    return logs.aggregated(_log(spark, d)).select("task", "stage", "subject", "repeat_count", "sequence")


@query("SELECT sequence FROM log WHERE (task = 'task3' OR contains(task || stage || 'run', 'task3')) AND contains(lower(upper(stage)), 'cl') AND sequence > 40", _LOG)
def log_search(spark, d):
    return logs.since(_log(spark, d), 40).where(logs.matches_task("task3") & logs.matches_text("CL", ("message",))).select("sequence")


@query("""SELECT task, min(sequence) AS "first", max(sequence) AS "last", count(*) AS length FROM (SELECT *, sum(c) OVER (PARTITION BY task ORDER BY sequence) AS g FROM (SELECT *,
    CASE WHEN lag(stage || '|' || subject) OVER (PARTITION BY task ORDER BY sequence) = stage || '|' || subject THEN 0 ELSE 1 END AS c FROM log) AS x) AS y GROUP BY task, g""", _LOG)
def log_runs(spark, d):
    return logs.run_lengths(_log(spark, d))


@query("SELECT 'failure' AS kind, count(*) AS entries, max(event_id) AS last_sequence FROM events WHERE event_type = 'purchase' UNION ALL SELECT 'execution', count(*), max(event_id) FROM events WHERE event_type <> 'purchase'")
def log_written(spark, d):
    """Log entries appended in two batches and read again by kind."""
    import uuid

    folder = f"{intermediates(spark)}/logs-{uuid.uuid4().hex}"
    entries = _log(spark, d).withColumn("kind", F.when(F.col("severity") == "error", "failure").otherwise("execution"))
    logs.append(entries.where("sequence % 2 = 0"), folder)
    logs.append(entries.where("sequence % 2 <> 0"), folder)
    read = [logs.written(spark, folder, kind).groupBy("kind").agg(F.count("*").alias("entries"), F.max("sequence").alias("last_sequence")) for kind in ("failure", "execution")]
    return read[0].unionByName(read[1])


# --- pixels ----------------------------------------------------------------------


def _pictures(spark, d, middle=128):
    """Small pictures drawn from embeddings: raw PPM of 16 x 4 pixels."""
    e = tables.table(spark, d, "embeddings")
    shade = F.transform("embedding", lambda x: F.lpad(F.hex(F.least(F.greatest((x * 40 + middle).cast("long"), F.lit(0)), F.lit(255))), 2, "0"))
    body = F.array_join(F.transform(shade, lambda h: F.concat(h, h, h)), "")
    return e.select("vec_id", F.unhex(F.concat(F.hex(F.lit("P6\n16 4\n255\n").cast("binary")), body)).alias("content"))


@query()
def image_features(spark, d):
    """dHash, PDQ, quality and zoned hashes of pictures."""
    return images.with_features(_pictures(spark, d), plane=False)


@query()
def structural_gate(spark, d):
    """Structural comparison of each picture with the next one, and the gate's decision."""
    p = _pictures(spark, d)
    n = p.select((F.col("vec_id") - 1).alias("vec_id"), F.col("content").alias("next_content"))
    both = dealt(p, "vec_id", rows=images.TASK_IMAGES).join(n.hint("merge"), "vec_id")
    c = images.with_content_comparison(both, "content", "next_content")
    low = gates.is_low_quality("left_quality", "right_quality")
    return c.select("vec_id", "c.edge_zncc", "c.trimmed_block", "c.passing_share", gates.structural_accept("c.edge_zncc", "c.trimmed_block", "c.passing_share", low).alias("accepted"))


@query("SELECT event_id, epoch_us(ts) // 1000 AS ms, CAST((epoch_us(ts) // 1000 + 11644473600000) * 10000 AS BIGINT) AS filetime, strftime(ts, '%Y-%m-%d %H:%M:%S.%g') AS utc, CAST(round(value * 1000000) AS BIGINT) AS millionths FROM events")
def scalar_functions(spark, d):
    e = tables.table(spark, d, "events")
    filetime = (media.epoch_ms("ts") + 11_644_473_600_000) * 10_000
    return e.select("event_id", media.filetime_to_ms(filetime).alias("ms"), filetime.alias("filetime"), media.utc_text(media.epoch_ms("ts")).alias("utc"), media.millionths("value").alias("millionths"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE CAST(9223372036854775807 - c_custkey + c_custkey AS VARCHAR) END AS total FROM customer")
def checked_sums(spark, d):
    """Sums of 64-bit counts as text, null where they would overflow."""
    key = F.col("c_custkey").cast("long")
    return tables.table(spark, d, "customer").select("c_custkey", media.checked_add(F.lit(9223372036854775807) - key, key + F.when(key % 2 == 0, 1).otherwise(0)).cast("string").alias("total"))


from twinsift.plans import growing  # noqa: E402, F401  registers its queries
