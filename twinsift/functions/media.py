"""Rules on paths, files and media contents as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from twinsift.functions.bits import _c, hamming

# File extensions by kind of media.
IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".bmp", ".gif", ".webp", ".tif", ".tiff", ".heic", ".avif")
VIDEO_EXTENSIONS = (".mp4", ".mkv", ".avi", ".mov", ".wmv", ".flv", ".webm", ".m4v", ".ts", ".mts", ".m2ts")
AUDIO_EXTENSIONS = (".mp3", ".flac", ".wav", ".aac", ".m4a", ".ogg", ".opus", ".wma", ".ape", ".alac")
# Stored codes.
OTHER, IMAGE, VIDEO, AUDIO = 0, 1, 2, 3
STATES = ("Pending", "Available", "Unchanged", "Changed", "Missing", "Offline", "OutOfScope", "ProgramDeleted", "Unreadable", "ReadTimeout")
STATE = {name: code for code, name in enumerate(STATES)}
STATIC_LIMIT = 75  # sum of the 15 distances of six frames
FNV_START, FNV_PRIME = 1469598103934665603, 1099511628211


def normalize_path(path: Column | str) -> Column:
    return F.lower(F.replace(_c(path), F.lit("/"), F.lit("\\")))


def extension(path: Column | str) -> Column:
    """Lower-case extension with its dot; empty without one."""
    return F.regexp_extract(F.lower(_c(path)), r"(\.[^.\\/]+)$", 1)


def classify_media(ext: Column | str) -> Column:
    ext = F.lower(_c(ext))
    return F.when(ext.isin(*IMAGE_EXTENSIONS), IMAGE).when(ext.isin(*VIDEO_EXTENSIONS), VIDEO).when(ext.isin(*AUDIO_EXTENSIONS), AUDIO).otherwise(OTHER)


def under_root(path: Column | str, root: Column | str) -> Column:
    """Path equals the root or lies below it; both normalised."""
    path, base = _c(path), F.rtrim(_c(root), F.lit("\\"))
    return (path == base) | path.startswith(F.concat(base, F.lit("\\")))


def is_active(sha: Column | str, state: Column | str) -> Column:
    return _c(sha).isNotNull() & _c(state).isin(STATE["Available"], STATE["Unchanged"])


def can_reuse(old: str, new: str) -> Column:
    """A stored path row may be reused for a discovered file: same size, time and known identity."""
    o, n = (lambda c: F.col(f"{old}.{c}")), (lambda c: F.col(f"{new}.{c}"))
    same = [o(c) == n(c) for c in ("size_bytes", "last_write_time_utc_ms", "volume_serial", "file_id_high", "file_id_low")]
    known = o("sha512").isNotNull() & ((n("file_id_high") != 0) | (n("file_id_low") != 0))
    out = known
    for s in same:
        out = out & s
    return F.coalesce(out, F.lit(False))


def image_features_complete(kind="media_kind", pdq="image_pdq", quality="image_pdq_quality", zoned="image_zoned_phashes", perceptual="image_perceptual_algorithm_version", structural="image_structural_algorithm_version", version: int = 1) -> Column:
    there = (_c(kind) == IMAGE) & _c(pdq).isNotNull() & _c(quality).isNotNull() & _c(zoned).isNotNull()
    return F.coalesce(there & (_c(perceptual) == version) & (_c(structural) == version), F.lit(False))


def missing_features(version: str, media="media_algorithm_version", pdq="image_pdq", quality="image_pdq_quality", zoned="image_zoned_phashes", perceptual="image_perceptual_algorithm_version", structural="image_structural_algorithm_version", wanted: int = 1) -> Column:
    """Names of what an image's content lacks, as an array; a version that is null or another one counts as lacking."""
    lacks = {
        "media_version": ~_c(media).eqNullSafe(F.lit(version)), "pdq": _c(pdq).isNull(), "quality": _c(quality).isNull(), "zoned": _c(zoned).isNull(),
        "perceptual_version": ~_c(perceptual).eqNullSafe(F.lit(wanted)), "structural_version": ~_c(structural).eqNullSafe(F.lit(wanted)),
    }
    return F.array_compact(F.array(*[F.when(lack, F.lit(name)) for name, lack in lacks.items()]))


def media_complete(version: str, kind="media_kind", dhash="image_dhash", frames="video_dhashes", stored="media_algorithm_version", duration="video_duration_ms") -> Column:
    """All that is stored for a kind of media is there, in the wanted algorithm version."""
    same = _c(stored) == version
    frames_ok = _c(frames).isNotNull() & F.forall(frames, lambda h: h != 0) & (_c(duration) > 0)
    rule = F.when(_c(kind) == IMAGE, same & _c(dhash).isNotNull() & (_c(dhash) != 0)).when(_c(kind) == VIDEO, same & frames_ok).when(_c(kind) == AUDIO, same).otherwise(F.lit(True))
    return F.coalesce(rule, F.lit(False))


def visual_status(kind="media_kind", dhash="image_dhash", frames="video_dhashes") -> Column:
    zero = F.exists(_c(frames), lambda h: h == 0)
    image = F.when(_c(dhash).isNotNull() & (_c(dhash) != 0), "Valid").otherwise("InvalidImage")
    video = F.when(_c(frames).isNull(), "MissingVideo").when(zero, "ZeroVideoFrame").otherwise("Valid")
    return F.when(_c(kind) == IMAGE, image).when(_c(kind) == VIDEO, video).otherwise("UnsupportedMedia")


def pairwise_frame_sum(frames: Column | str, n: int = 6) -> Column:
    """Sum of the distances of all pairs of frames."""
    frames, total = _c(frames), F.lit(0)
    for i in range(n):
        for j in range(i + 1, n):
            total = total + hamming(F.get(frames, F.lit(i)), F.get(frames, F.lit(j)))
    return total


def is_static(frames: Column | str) -> Column:
    return pairwise_frame_sum(frames) < STATIC_LIMIT


def is_usable_visual(kind="media_kind", frames="video_dhashes", static="static_visual") -> Column:
    video = (visual_status(kind=kind, frames=frames) == "Valid") & ~F.coalesce(_c(static), is_static(frames))
    return F.when(_c(kind) == IMAGE, image_features_complete(kind)).when(_c(kind) == VIDEO, video).otherwise(F.lit(False))


def aspect_grade(width: Column | str, height: Column | str) -> Column:
    """Aspect ratio times 100 000, rounded half up, in integers; 0 without a height."""
    w, h = _c(width).cast("long"), _c(height).cast("long")
    half = F.floor(h / 2).cast("long")
    up = w * 100_000 + half
    return F.when(h > 0, F.floor((up - up % h) / h).cast("long")).otherwise(F.lit(0).cast("long"))


def aspect_compatible(w1, h1, w2, h2, tolerance_percent: int = 1) -> Column:
    """Ratios differ by at most the tolerance, relative to the larger; exact in integers."""
    w1, h1, w2, h2 = (_c(x).cast("long") for x in (w1, h1, w2, h2))
    a, b = w1 * h2, w2 * h1
    return F.coalesce((w1 > 0) & (h1 > 0) & (w2 > 0) & (h2 > 0) & (F.abs(a - b) * 100 <= F.greatest(a, b) * tolerance_percent), F.lit(False))


def normalize_target(key: Column | str) -> Column:
    return F.lower(F.trim(_c(key)))


def checked_add(a: Column | str, b: Column | str) -> Column:
    """Sum of two 64-bit counts; null where it would overflow, instead of the error that ``+`` raises."""
    return F.try_add(_c(a).cast("long"), _c(b).cast("long"))


def millionths(score: Column | str) -> Column:
    """Score as an integer number of millionths, half away from zero; 0 for what is no number."""
    s = _c(score).cast("double")
    bad = s.isNull() | F.isnan(s) | (F.abs(s) == F.lit(float("inf")))
    return F.when(bad, F.lit(0).cast("long")).otherwise(F.round(s * 1_000_000).cast("long"))


def filetime_to_ms(filetime: Column | str) -> Column:
    """Epoch milliseconds of a count of 100 ns since 1601."""
    t = _c(filetime).cast("long")
    return F.floor((t - t % 10_000) / 10_000).cast("long") - F.lit(11_644_473_600_000)


_EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def epoch_ms(ts: Column | str) -> Column:
    """Milliseconds since 1970 of a timestamp without time zone."""
    return F.timestamp_diff("MILLISECOND", F.expr(_EPOCH), _c(ts).cast("timestamp_ntz"))


def utc_text(ms: Column | str) -> Column:
    """UTC text of epoch milliseconds, whatever the session's time zone."""
    return F.date_format(F.timestamp_add("MILLISECOND", _c(ms), F.expr(_EPOCH)), "yyyy-MM-dd HH:mm:ss.SSS")


def one_line(text: Column | str) -> Column:
    return F.regexp_replace(_c(text), r"[\r\n\t]", " ")


def decimal_key(number: Column | str) -> Column:
    """Twenty-digit text whose order is the number's."""
    return F.lpad(_c(number).cast("string"), 20, "0")


def sha512_hex(data: Column | str) -> Column:
    return F.sha2(_c(data), 512)


def sha512_bytes(text: Column | str) -> Column:
    """Bytes of a hex digest of any case; null unless it has 128 hex digits."""
    t = _c(text)
    return F.when(t.rlike("^[0-9A-Fa-f]{128}$"), F.unhex(t))


def path_hash(path: Column | str) -> Column:
    return F.sha2(normalize_path(path), 256)


def stable_group_id(text: Column, kind: int | None = None) -> Column:
    """64-bit fold of a group's key; of its bytes for exact groups (hex key, no kind), of its text for similar ones.

    The multiplication wraps at 64 bits, which SQL arithmetic refuses, so the fold runs in NumPy, one step a character position for a whole batch.
    """

    @F.arrow_udf("long")
    def fold(keys):
        import numpy as np
        import pyarrow as pa

        rows = [None if k is None else (bytes.fromhex(k) if kind is None else k.encode()) for k in keys.to_pylist()]
        width = max((len(r) for r in rows if r), default=0)
        sizes = np.array([len(r or b"") for r in rows])
        data = np.zeros((len(rows), width), np.uint64)
        for i, r in enumerate(rows):
            if r:
                data[i, : len(r)] = np.frombuffer(r, np.uint8)
        value = np.full(len(rows), FNV_START ^ (kind or 0), np.uint64)
        for j in range(width):
            value = np.where(sizes > j, (value ^ data[:, j]) * np.uint64(FNV_PRIME), value)
        return pa.array([None if r is None else v for r, v in zip(rows, value.view(np.int64).tolist(), strict=True)], pa.int64())

    return fold(text)
