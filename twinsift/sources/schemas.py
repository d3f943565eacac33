"""Declared schemas and their check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

PATHS = "path_id BIGINT, full_path STRING, normalized_path STRING, sha512 STRING, scan_id BIGINT, volume_serial BIGINT, file_id_high BIGINT, file_id_low BIGINT, volume_guid STRING, storage_target_key STRING, size_bytes BIGINT, extension STRING, creation_time_utc_ms BIGINT, last_write_time_utc_ms BIGINT, scan_root_priority INT, path_state INT, active BOOLEAN"
CONTENTS = "sha512 STRING, content_size_bytes BIGINT, media_kind INT, mime_type STRING, container_name STRING, width BIGINT, height BIGINT, image_dhash BIGINT, image_pdq ARRAY<BIGINT>, image_pdq_quality INT, image_zoned_phashes ARRAY<BIGINT>, image_perceptual_algorithm_version INT, image_structural_algorithm_version INT, video_duration_ms BIGINT, video_frame_rate DOUBLE, video_bitrate BIGINT, video_codec STRING, pixel_format STRING, video_dhashes ARRAY<BIGINT>, static_visual BOOLEAN, contact_sheet_path STRING, media_algorithm_version STRING"
MANIFEST = "path STRING, normalized_path STRING, volume_guid STRING, storage_target_key STRING, size_bytes BIGINT, extension STRING, creation_time_utc_ms BIGINT, last_write_time_utc_ms BIGINT, scan_root_priority INT, scan_id BIGINT, media_kind INT, physical_start_byte BIGINT"
OUTBOX = "sequence BIGINT, batch_scan_id BIGINT, kind STRING, key STRING, payload STRING, attempt_count INT, next_attempt_utc_ms BIGINT"
SKIPPED = "primary_sha STRING, secondary_sha STRING, media_kind INT, reason INT, active_path_count BIGINT, sample_paths ARRAY<STRING>"


def validate_schema(df: DataFrame, contract: str) -> list[str]:
    """Differences from a contract: missing columns and other types. Extra columns are allowed."""
    have = {f.name: f.dataType.simpleString() for f in df.schema}
    return [f"{f.name}: expected {f.dataType.simpleString()}, found {have.get(f.name, 'none')}" for f in StructType.fromDDL(contract) if have.get(f.name) != f.dataType.simpleString()]
