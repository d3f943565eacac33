"""Pixel features of decoded gray images in NumPy, and their forms over batches of rows.

Images come as plain PPM (P3 or P6) bytes, the one format that needs no decoder
library; others arrive as feature columns. Resampling is by box means downwards and
linear upwards, so hashes agree with other resamplers in decisions, not bit by bit.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

from twinsift.plans.storage import arrow_rows

SIDE, BLOCK, TILES = 256, 16, 4
# Fixed values of the structural similarity index for 8-bit samples.
C1, C2 = 6.5025, 58.5225
FEATURES = StructType([
    StructField("width", LongType()), StructField("height", LongType()), StructField("image_dhash", LongType()), StructField("image_pdq", ArrayType(LongType())),
    StructField("image_pdq_quality", IntegerType()), StructField("image_zoned_phashes", ArrayType(LongType())), StructField("plane", BinaryType()), StructField("error", StringType()),
])
COMPARED = StructType([StructField("edge_zncc", IntegerType()), StructField("trimmed_block", IntegerType()), StructField("passing_share", IntegerType())])


def parse_ppm(data: bytes) -> np.ndarray:
    """RGB array of a plain or raw PPM with at most 255 as maximum."""
    kind, fields, at = data[:2], [], 2
    if kind not in (b"P3", b"P6"):
        raise ValueError("no PPM")
    while len(fields) < 3:
        while data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at)
            continue
        end = at
        while end < len(data) and not data[end : end + 1].isspace():
            end += 1
        if end == at:
            raise ValueError("short PPM header")
        fields.append(int(data[at:end]))
        at = end
    width, height, top = fields
    need = width * height * 3
    if width < 1 or height < 1 or not 0 < top <= 255:
        raise ValueError("unsupported PPM")
    body = np.frombuffer(data, np.uint8, need, at + 1) if kind == b"P6" else np.array(data[at:].split()[:need], np.uint8)
    if len(body) < need:
        raise ValueError("short PPM")
    return (body.reshape(height, width, 3).astype(np.float64) * (255 / top)) if top != 255 else body.reshape(height, width, 3).astype(np.float64)


def luma(rgb: np.ndarray) -> np.ndarray:
    return rgb @ np.array([0.299, 0.587, 0.114])


def _spread(source: int, target: int) -> np.ndarray:
    """Matrix of box means from ``source`` to ``target`` samples; of linear interpolation if there are more."""
    if target > source:
        at = np.clip((np.arange(target) + 0.5) * source / target - 0.5, 0, source - 1)
        return np.clip(1 - np.abs(at[:, None] - np.arange(source)[None, :]), 0, 1)
    edges = np.linspace(0, source, target + 1)
    lo, hi = edges[:-1, None], edges[1:, None]
    cells = np.arange(source)[None, :]
    overlap = np.clip(np.minimum(hi, cells + 1) - np.maximum(lo, cells), 0, None)
    return overlap / overlap.sum(1, keepdims=True)


def resize(gray: np.ndarray, height: int, width: int) -> np.ndarray:
    return _spread(gray.shape[0], height) @ gray @ _spread(gray.shape[1], width).T


def _word(bits: np.ndarray) -> int:
    """Signed BIGINT of 64 bits, most significant first."""
    return int.from_bytes(np.packbits(bits.astype(np.uint8)).tobytes(), "big", signed=True)


def dhash(gray9x8: np.ndarray) -> int:
    """64 bits: each sample of a row is darker than the next one."""
    return _word((gray9x8[:, :-1] < gray9x8[:, 1:]).ravel())


def dct_rows(n: int, side: int, first: int = 0) -> np.ndarray:
    """Rows ``first`` .. ``first + n - 1`` of the orthonormal DCT-II of ``side`` samples."""
    k, x = np.arange(first, first + n)[:, None], np.arange(side)[None, :]
    scale = np.where(k == 0, np.sqrt(1 / side), np.sqrt(2 / side))
    return scale * np.cos(np.pi * (2 * x + 1) * k / (2 * side))


def zone_phash(tile: np.ndarray) -> int:
    """Bit k of the 8 x 8 lowest frequencies is set if coefficient k exceeds the median of all but the first."""
    small = tile.reshape(32, 2, 32, 2).mean(axis=(1, 3))
    d = dct_rows(8, 32)
    coefficients = (d @ small @ d.T).ravel()
    median = np.partition(coefficients[1:], 31)[31]
    bits = coefficients > median
    bits[0] = False
    return _word(bits[::-1])


def pdq(gray64: np.ndarray) -> tuple[list[int], int]:
    """256 bits of the 16 x 16 frequencies 1..16 against their median, and a quality from 0 to 100 by gradient strength."""
    d = dct_rows(16, 64, 1)
    coefficients = d @ gray64 @ d.T
    bits = (coefficients > np.median(coefficients)).ravel()[::-1]
    steps = np.abs(np.diff(gray64, axis=0)).astype(int).sum() * 100 // 255 + np.abs(np.diff(gray64, axis=1)).astype(int).sum() * 100 // 255
    return [_word(bits[i : i + 64]) for i in range(0, 256, 64)], int(np.clip(steps // 90, 0, 100))


def edges(gray: np.ndarray) -> np.ndarray:
    """Capped sum of absolute Sobel gradients; borders repeat."""
    p = np.pad(gray.astype(np.int32), 1, mode="edge")
    gx = (p[:-2, 2:] + 2 * p[1:-1, 2:] + p[2:, 2:]) - (p[:-2, :-2] + 2 * p[1:-1, :-2] + p[2:, :-2])
    gy = (p[2:, :-2] + 2 * p[2:, 1:-1] + p[2:, 2:]) - (p[:-2, :-2] + 2 * p[:-2, 1:-1] + p[:-2, 2:])
    return np.minimum(np.abs(gx) + np.abs(gy), 2040)


def _correlation(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Zero-mean normalised correlation along the last axis, from 0 to 1; 1 or 0 for flat input, by identity."""
    x, y = a - a.mean(-1, keepdims=True), b - b.mean(-1, keepdims=True)
    power = (x * x).sum(-1) * (y * y).sum(-1)
    same = (a == b).all(-1).astype(float)
    return np.where(power > 0, np.clip((x * y).sum(-1) / np.sqrt(np.where(power > 0, power, 1)), 0, 1), same)


def compare_planes(left: bytes, right: bytes, pass_score: float = 0.9) -> tuple[int, int, int]:
    """Edge correlation, trimmed block score and share of passing blocks, in millionths."""
    a, b = (np.frombuffer(x, np.uint8).reshape(SIDE, SIDE) for x in (left, right))
    blocks = lambda g: g.reshape(SIDE // BLOCK, BLOCK, SIDE // BLOCK, BLOCK).swapaxes(1, 2).reshape(-1, BLOCK * BLOCK).astype(np.float64)
    x, y = blocks(a), blocks(b)
    mx, my = x.mean(1), y.mean(1)
    cov = (x * y).mean(1) - mx * my
    ssim = np.clip((2 * mx * my + C1) * (2 * cov + C2) / ((mx * mx + my * my + C1) * (x.var(1) + y.var(1) + C2)), 0, 1)
    scores = 0.65 * _correlation(x, y) + 0.35 * ssim
    edge = float(_correlation(edges(a).ravel().astype(np.float64), edges(b).ravel().astype(np.float64)))
    trimmed = float(np.sort(scores)[len(scores) // 4 :].mean())
    return tuple(int(np.floor(v * 1_000_000 + 0.5)) for v in (edge, trimmed, float((scores >= pass_score).mean())))


def square_plane(gray: np.ndarray) -> np.ndarray:
    """The image's gray values in ``SIDE`` x ``SIDE`` bytes."""
    return np.clip(np.rint(resize(gray, SIDE, SIDE)), 0, 255).astype(np.uint8)


def plane_and_quality(data: bytes | None) -> tuple[bytes | None, int | None]:
    """Plane and PDQ quality of one image, as in ``image_features``; none of a bad image."""
    try:
        gray = luma(parse_ppm(data or b""))
        return square_plane(gray).tobytes(), pdq(resize(gray, 64, 64))[1]
    except (ValueError, OverflowError):
        return None, None


def image_features(data: bytes | None) -> dict:
    """All features of one image, or its error; a bad image never fails a job."""
    try:
        rgb = parse_ppm(data or b"")
        gray = luma(rgb)
        square = square_plane(gray)
        tiles = square.astype(np.float64).reshape(TILES, SIDE // TILES, TILES, SIDE // TILES).swapaxes(1, 2).reshape(-1, 64, 64)
        words, quality = pdq(resize(gray, 64, 64))
        return {
            "width": rgb.shape[1], "height": rgb.shape[0], "image_dhash": dhash(np.rint(resize(gray, 8, 9))), "image_pdq": words, "image_pdq_quality": quality,
            "image_zoned_phashes": [zone_phash(t) for t in tiles], "plane": square.tobytes(), "error": None,
        }
    except (ValueError, OverflowError) as e:
        return {f.name: None for f in FEATURES} | {"error": str(e)}


#: Images whose features leave a task in one batch: 4 MB of planes.
STEP_IMAGES = 64
#: Images of a task, at most on average; their bytes are few beside the time they take.
TASK_IMAGES = 2_000


def with_features(rows: DataFrame, content: str = "content", plane: bool = True, step: int = STEP_IMAGES) -> DataFrame:
    """``rows`` with the features of each image's bytes in place of ``content``.

    Planes (64 kB an image) are made only where asked for, and leave a task in batches of ``step`` images; input
    batches are bounded by their bytes. So a task's memory does not depend on the number of images.
    """
    arrow_rows(rows.sparkSession)
    fields = [f for f in FEATURES if plane or f.name != "plane"]
    others = [f for f in rows.schema if f.name != content]
    schema = StructType(others + fields)

    def extracted(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(schema)
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                found = [image_features(x.as_py()) for x in part[content]]
                columns = [part[f.name] for f in others] + [pa.array([x[f.name] for x in found], kinds.field(f.name).type) for f in fields]
                yield pa.RecordBatch.from_arrays(columns, [*kinds.names])

    return rows.mapInArrow(extracted, schema)


def with_planes(rows: DataFrame, content: str = "content", step: int = STEP_IMAGES) -> DataFrame:
    """``rows`` with the plane of each image's bytes in ``plane`` in place of ``content``, in batches of ``step`` images; null of a bad image."""
    arrow_rows(rows.sparkSession)
    others = [f for f in rows.schema if f.name != content]

    def planes(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                made = pa.array([plane_and_quality(x.as_py())[0] for x in part[content]], pa.binary())
                yield pa.RecordBatch.from_arrays([*[part[f.name] for f in others], made], [*[f.name for f in others], "plane"])

    return rows.mapInArrow(planes, StructType([*others, StructField("plane", BinaryType())]))


def with_content_comparison(rows: DataFrame, left: str, right: str, pass_score: float = 0.9) -> DataFrame:
    """``rows`` with the structural comparison of two images in ``c`` and their qualities in place of their bytes; null where an image is bad.

    Planes are made where they are compared, two at a time: none is stored, shuffled or read in columns (thousands of
    planes at once are hundreds of MB).
    """
    arrow_rows(rows.sparkSession)
    others = [f for f in rows.schema if f.name not in (left, right)]
    schema = StructType([*others, StructField("c", COMPARED), StructField("left_quality", IntegerType()), StructField("right_quality", IntegerType())])

    def structure(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        for batch in batches:
            found, qualities = [], ([], [])
            for x, y in zip(batch[left], batch[right], strict=True):
                (a, p), (b, q) = plane_and_quality(x.as_py()), plane_and_quality(y.as_py())
                found.append(None if a is None or b is None else dict(zip(("edge_zncc", "trimmed_block", "passing_share"), compare_planes(a, b, pass_score), strict=True)))
                qualities[0].append(p)
                qualities[1].append(q)
            made = [pa.array(found, to_arrow_type(COMPARED)), *[pa.array(q, pa.int32()) for q in qualities]]
            yield pa.RecordBatch.from_arrays([*[batch[f.name] for f in others], *made], [f.name for f in schema])

    return rows.mapInArrow(structure, schema)


def with_comparison(rows: DataFrame, left: str, right: str, pass_score: float = 0.9) -> DataFrame:
    """``rows`` with the structural comparison of two planes in ``c`` in their place; null if one is missing.

    A batch is bounded by its bytes, and two planes at a time are compared.
    """
    arrow_rows(rows.sparkSession)
    others = [f for f in rows.schema if f.name not in (left, right)]
    schema = StructType([*others, StructField("c", COMPARED)])

    def structure(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        for batch in batches:
            pairs = ((a.as_py(), b.as_py()) for a, b in zip(batch[left], batch[right], strict=True))
            found = [None if a is None or b is None else dict(zip(("edge_zncc", "trimmed_block", "passing_share"), compare_planes(a, b, pass_score), strict=True)) for a, b in pairs]
            yield pa.RecordBatch.from_arrays([*[batch[f.name] for f in others], pa.array(found, to_arrow_type(COMPARED))], [*[f.name for f in others], "c"])

    return rows.mapInArrow(structure, schema)
