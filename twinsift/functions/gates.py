"""Similarity gates: threshold profiles, primary route, zoned hashes, structure and video."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from twinsift.functions.bits import _c, frame_distances, hamming, hamming_words
from twinsift.functions.media import aspect_compatible

VIDEO_WINDOW_MS = 2000
FRAMES = 6


@dataclass(frozen=True)
class Profile:
    """Thresholds of one quality class; distances are maxima, scores and counts minima."""

    pdq_max: int = 31
    fallback_dhash_max: int = 4
    tile_max: int = 10
    min_passing_tiles: int = 12
    max_ignored_tiles: int = 4
    trimmed_mean_max: int = 8
    edge_min: int = 780_000
    trimmed_block_min: int = 930_000
    block_pass_score: int = 900_000
    passing_share_min: int = 750_000


STANDARD = Profile()
LOW_QUALITY = Profile(24, 2, 8, 14, 2, 6, 850_000, 955_000, 930_000, 875_000)


@dataclass(frozen=True)
class Gates:
    standard: Profile = STANDARD
    low_quality: Profile = LOW_QUALITY
    pdq_min_quality: int = 50
    aspect_tolerance_percent: int = 1


def is_low_quality(left: Column | str, right: Column | str, gates: Gates = Gates()) -> Column:
    """Either quality is missing or below the minimum."""
    ok = (_c(left) >= gates.pdq_min_quality) & (_c(right) >= gates.pdq_min_quality)
    return ~F.coalesce(ok, F.lit(False))


def limit(name: str, low: Column, gates: Gates = Gates()) -> Column:
    """A threshold by quality class."""
    return F.when(low, F.lit(asdict(gates.low_quality)[name])).otherwise(F.lit(asdict(gates.standard)[name]))


def primary_route(left: str, right: str, gates: Gates = Gates()) -> Column:
    """``Pdq``, ``DHashFallback`` or null for a pair of joined rows; the two never hold together."""
    l, r = (lambda c: F.col(f"{left}.{c}")), (lambda c: F.col(f"{right}.{c}"))
    low = is_low_quality(l("image_pdq_quality"), r("image_pdq_quality"), gates)
    near = hamming_words(l("image_pdq"), r("image_pdq")) <= limit("pdq_max", low, gates)
    fallback = hamming(l("image_dhash"), r("image_dhash")) <= limit("fallback_dhash_max", low, gates)
    aspect = aspect_compatible(l("width"), l("height"), r("width"), r("height"), gates.aspect_tolerance_percent)
    return F.when(aspect, F.when(F.coalesce(near, F.lit(False)), "Pdq").when(F.coalesce(fallback, F.lit(False)), "DHashFallback"))


def zoned_evidence(left: Column | str, right: Column | str, low: Column, gates: Gates = Gates()) -> Column:
    """Struct of the comparison of 16 tile hashes: accepted, passing, retained, ignored and trimmed_sum."""
    distances = F.array_sort(frame_distances(left, right))
    tile, need = limit("tile_max", low, gates), limit("min_passing_tiles", low, gates)
    passing = F.size(F.filter(distances, lambda d: d <= tile))
    retained = F.least(need, F.lit(16))
    trimmed = F.aggregate(F.slice(distances, F.lit(1), retained), F.lit(0), lambda s, d: s + d)
    ignored = 16 - retained
    ok = (passing >= need) & (ignored <= limit("max_ignored_tiles", low, gates)) & (trimmed <= limit("trimmed_mean_max", low, gates) * retained)
    return F.struct(F.coalesce(ok, F.lit(False)).alias("accepted"), passing.alias("passing"), retained.alias("retained"), ignored.alias("ignored"), trimmed.alias("trimmed_sum"))


def structural_accept(edge: Column | str, trimmed: Column | str, share: Column | str, low: Column, gates: Gates = Gates()) -> Column:
    """All three structural minima hold, in millionths."""
    return (_c(edge) >= limit("edge_min", low, gates)) & (_c(trimmed) >= limit("trimmed_block_min", low, gates)) & (_c(share) >= limit("passing_share_min", low, gates))


def video_total(left: Column | str, right: Column | str) -> Column:
    return hamming_words(left, right)
