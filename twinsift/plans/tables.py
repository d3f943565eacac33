"""The engine's input tables derived from the test tables, in Spark and as SQL text of the same meaning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsift.functions import media

EXTENSIONS = (".JPG", ".png", ".mp4", ".MKV", ".flac", ".txt", ".webm", "")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: id, path, digest, size, times, disk, priority and state."""
    d = table(spark, sf_dir, "documents")
    ext = F.element_at(F.array(*[F.lit(e) for e in EXTENSIONS]), (F.col("doc_id") % 8 + 1).cast("int"))
    return d.select(
        F.col("doc_id").alias("path_id"),
        F.concat(F.lit("D:/"), "source", F.lit("/"), "lang", F.lit("/F"), F.col("doc_id").cast("string"), ext).alias("full_path"),
        F.sha2("text", 256).alias("sha"),
        F.col("n_chars").alias("size_bytes"),
        F.col("source").alias("storage_target_key"),
        (F.col("doc_id") % 3).cast("int").alias("scan_root_priority"),
        (F.col("doc_id") % 10).cast("int").alias("path_state"),
        (F.col("doc_id") * 7919 % 100_000).alias("last_write_time_utc_ms"),
    ).withColumn("active", media.is_active("sha", "path_state"))


PATHS = """
paths AS (SELECT *, sha IS NOT NULL AND path_state IN (1, 2) AS active FROM (
    SELECT doc_id AS path_id,
           'D:/' || source || '/' || lang || '/F' || CAST(doc_id AS VARCHAR) || CASE doc_id % 8 WHEN 0 THEN '.JPG' WHEN 1 THEN '.png' WHEN 2 THEN '.mp4' WHEN 3 THEN '.MKV'
               WHEN 4 THEN '.flac' WHEN 5 THEN '.txt' WHEN 6 THEN '.webm' ELSE '' END AS full_path,
           sha256(text) AS sha, n_chars AS size_bytes, source AS storage_target_key, CAST(doc_id % 3 AS INTEGER) AS scan_root_priority,
           CAST(doc_id % 10 AS INTEGER) AS path_state, doc_id * 7919 % 100000 AS last_write_time_utc_ms
    FROM documents) AS x)"""


def contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct contents with a kind by language and feature columns by size."""
    n = F.col("n")
    grouped = paths(spark, sf_dir).join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path_id"), "lang"), "path_id").groupBy("sha").agg(F.min("size_bytes").alias("n"), F.min("lang").alias("lang"))
    return grouped.select(
        "sha", n.alias("content_size_bytes"),
        F.when(F.col("lang") == "en", 1).when(F.col("lang") == "de", 2).when(F.col("lang") == "fr", 3).otherwise(0).alias("media_kind"),
        (n % 13 * 160 + 160).alias("width"), (n % 7 * 120 + 120).alias("height"),
        F.when(n % 5 != 0, n % 4 * 21).alias("image_dhash"),
        F.when(n % 3 != 0, n % 101).cast("int").alias("image_pdq_quality"),
        F.when(n % 6 != 0, F.transform(F.sequence(F.lit(1), F.lit(6)), lambda i: (n * i) % 97)).alias("video_dhashes"),
    )


CONTENTS = PATHS + """,
contents AS (
    SELECT sha, n AS content_size_bytes, CASE lang WHEN 'en' THEN 1 WHEN 'de' THEN 2 WHEN 'fr' THEN 3 ELSE 0 END AS media_kind,
           n % 13 * 160 + 160 AS width, n % 7 * 120 + 120 AS height, CASE WHEN n % 5 <> 0 THEN n % 4 * 21 END AS image_dhash,
           CASE WHEN n % 3 <> 0 THEN CAST(n % 101 AS INTEGER) END AS image_pdq_quality,
           CASE WHEN n % 6 <> 0 THEN [n % 97, (n * 2) % 97, (n * 3) % 97, (n * 4) % 97, (n * 5) % 97, (n * 6) % 97] END AS video_dhashes
    FROM (SELECT sha, min(size_bytes) AS n, min(lang) AS lang FROM paths JOIN documents ON doc_id = path_id GROUP BY sha) AS g)"""


def featured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents with all feature columns and algorithm versions, some of them missing or old."""
    n = F.col("content_size_bytes")
    return contents(spark, sf_dir).withColumns({
        "image_pdq": F.when(n % 5 != 0, F.array(n, n + 1, n + 2, n + 3)),
        "image_zoned_phashes": F.when(n % 7 != 0, F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: (n * (i + 3)) % 31)),
        "image_perceptual_algorithm_version": F.when(n % 11 != 0, 1).otherwise(0),
        "image_structural_algorithm_version": F.when(n % 13 != 0, 1),
        "media_algorithm_version": F.when(n % 4 != 0, "2").otherwise("1"),
        "video_duration_ms": n * 37 % 20_000,
        "static_visual": F.when(n % 17 == 0, True),
    })


FEATURED = CONTENTS + """,
featured AS (SELECT *, complete_image AND media_kind = 1 AS complete FROM (SELECT *, missing = '' OR missing = 'media_version' AS complete_image FROM (SELECT *, n % 4 <> 0 AS present_version, n * 37 % 20000 AS video_duration_ms,
    concat_ws(',', CASE WHEN n % 4 = 0 THEN 'media_version' END, CASE WHEN n % 5 = 0 THEN 'pdq' END, CASE WHEN n % 3 = 0 THEN 'quality' END, CASE WHEN n % 7 = 0 THEN 'zoned' END,
        CASE WHEN n % 11 = 0 THEN 'perceptual_version' END, CASE WHEN n % 13 = 0 THEN 'structural_version' END) AS missing
    FROM (SELECT *, content_size_bytes AS n FROM contents) AS c) AS x) AS y)"""


def sign_bits(first: int, count: int, column: str = "embedding") -> Column:
    """Signs of ``count`` dimensions from ``first`` (0-based) as a number, the first one lowest."""
    return F.expr(f"aggregate(transform(slice({column}, {first + 1}, {count}), (x, i) -> if(x > 0, shiftleft(1L, i), 0L)), 0L, (s, x) -> s + x)")


def sign_sql(first: int, count: int, column: str = "embedding") -> str:
    return "(" + " + ".join(f"CASE WHEN {column}[{first + i + 1}] > 0 THEN {1 << i}::BIGINT ELSE 0 END" for i in range(count)) + ")"


def signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as words of sign bits: 16 bits, four words, and six frames of seven bits, each repeated eight times."""
    e = table(spark, sf_dir, "embeddings")
    frames = F.array(*[sign_bits(7 * k, 7) * F.lit(0x0101010101010101) for k in range(6)])
    return e.select(F.col("vec_id").alias("id"), sign_bits(0, 16).alias("w16"), F.array(*[sign_bits(16 * k, 16) for k in range(4)]).alias("words"), frames.alias("frames"), (F.col("vec_id") * 37 % 20_000).alias("ms"), "label")


SIGNATURES = f"""
signatures AS (SELECT vec_id AS id, {sign_sql(0, 16)} AS w16, {sign_sql(0, 16)} AS w0, {sign_sql(16, 16)} AS w1, {sign_sql(32, 16)} AS w2, {sign_sql(48, 16)} AS w3,
    {", ".join(f"{sign_sql(7 * k, 7)} AS f{k}" for k in range(6))}, vec_id * 37 % 20000 AS ms, label FROM embeddings)"""


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as members of their order's group."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("group_id"), (F.col("l_orderkey") * 10_000_000_000 + F.col("l_linenumber").cast("long") * 1_000_000_000 + F.col("l_partkey") * 10_000 + F.col("l_suppkey")).alias("path_id"), F.col("l_partkey").alias("size_bytes"),
        F.col("l_quantity").cast("long").alias("width"), (F.col("l_discount") * 100).cast("int").cast("long").alias("height"), F.col("l_suppkey").alias("bitrate"),
        media.epoch_ms("l_shipdate").alias("last_write_time_utc_ms"), (F.col("l_linenumber") % 3).alias("scan_root_priority"),
        F.concat(F.lit(" PhysicalDrive"), (F.col("l_suppkey") % 3).cast("string")).alias("storage_target_key"),
    )


MEMBERS = """
members AS (SELECT l_orderkey AS group_id, l_orderkey * 10000000000 + l_linenumber::BIGINT * 1000000000 + l_partkey * 10000 + l_suppkey AS path_id, l_partkey AS size_bytes, CAST(trunc(l_quantity) AS BIGINT) AS width,
    CAST(trunc(l_discount * 100) AS BIGINT) AS height, l_suppkey AS bitrate, epoch_us(l_shipdate) // 1000 AS last_write_time_utc_ms, l_linenumber % 3 AS scan_root_priority,
    ' PhysicalDrive' || CAST(l_suppkey % 3 AS VARCHAR) AS storage_target_key FROM lineitem)"""


def operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as outbox operations of five scans."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("sequence"), (F.col("event_id") % 5).alias("batch_scan_id"), F.when(F.col("event_type") == "click", "delete").otherwise("upsert").alias("kind"),
        F.col("user_id").alias("key"), F.col("event_type").alias("payload"), (F.col("event_id") % 9).cast("int").alias("attempt_count"), (F.col("event_id") * 31 % 1000).alias("next_attempt_utc_ms"),
    )


OPERATIONS = """
operations AS (SELECT event_id AS sequence, event_id % 5 AS batch_scan_id, CASE WHEN event_type = 'click' THEN 'delete' ELSE 'upsert' END AS kind, user_id AS key,
    event_type AS payload, CAST(event_id % 9 AS INTEGER) AS attempt_count, event_id * 31 % 1000 AS next_attempt_utc_ms FROM events)"""
