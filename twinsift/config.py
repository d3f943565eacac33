"""Configuration as dataclasses with range checks, stored as JSON with a backup."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, field, fields

from twinsift.functions.gates import LOW_QUALITY, STANDARD, Gates, Profile

VERSION = 5
# The Hamming recipe for 256 bits in 16 segments holds up to this radius.
PDQ_RADIUS_LIMIT = 31


class ConfigError(ValueError):
    def __init__(self, issues: list[str]):
        super().__init__("; ".join(issues))
        self.issues = issues


def _profile_issues(name: str, p: Profile) -> list[str]:
    ranges = {
        "pdq_max": (0, PDQ_RADIUS_LIMIT), "fallback_dhash_max": (0, 15), "tile_max": (0, 64), "min_passing_tiles": (1, 16), "max_ignored_tiles": (0, 15),
        "trimmed_mean_max": (0, 64), "edge_min": (0, 1_000_000), "trimmed_block_min": (0, 1_000_000), "block_pass_score": (0, 1_000_000), "passing_share_min": (0, 1_000_000),
    }
    return [f"{name}.{k}: {v} is not between {ranges[k][0]} and {ranges[k][1]}" for k, v in asdict(p).items() if not ranges[k][0] <= v <= ranges[k][1]]


def _looser(standard: Profile, low: Profile) -> list[str]:
    """The profile for low quality must be no looser than the standard one in any threshold."""
    smaller = {"pdq_max", "fallback_dhash_max", "tile_max", "max_ignored_tiles", "trimmed_mean_max"}
    s, l = asdict(standard), asdict(low)
    return [f"low_quality.{k} is looser than standard" for k in s if (l[k] > s[k] if k in smaller else l[k] < s[k])]


@dataclass(frozen=True)
class Config:
    schema_version: int = VERSION
    standard: Profile = STANDARD
    low_quality: Profile = LOW_QUALITY
    pdq_min_quality: int = 50
    aspect_tolerance_percent: int = 1
    image_dhash_max: int = 4
    video_average_max: int = 5
    hot_signature_max_members: int = 2048
    hot_signature_max_pairs: int = 2_000_000
    policies: tuple[str, ...] = field(default=("path_priority",))

    def __post_init__(self):
        issues = _profile_issues("standard", self.standard) + _profile_issues("low_quality", self.low_quality) + _looser(self.standard, self.low_quality)
        for name, lo, hi in (("pdq_min_quality", 0, 100), ("aspect_tolerance_percent", 0, 100), ("image_dhash_max", 0, 63), ("video_average_max", 0, 15), ("hot_signature_max_members", 2, 1_000_000), ("hot_signature_max_pairs", 1, 1 << 40)):
            if not lo <= getattr(self, name) <= hi:
                issues.append(f"{name} is not between {lo} and {hi}")
        if self.schema_version != VERSION:
            issues.append(f"schema_version {self.schema_version} is not supported")
        if issues:
            raise ConfigError(issues)

    @property
    def gates(self) -> Gates:
        return Gates(self.standard, self.low_quality, self.pdq_min_quality, self.aspect_tolerance_percent)


def save(config: Config, path: str) -> None:
    """Write beside the file, keep the old one as a backup, then swap."""
    with open(f"{path}.new", "w") as out:
        json.dump(asdict(config), out, indent=1)
    if os.path.exists(path):
        os.replace(path, f"{path}.bak")
    os.replace(f"{path}.new", path)


def load(path: str) -> Config:
    """The stored configuration; a damaged file falls back to its backup, a newer version is refused."""
    for name in (path, f"{path}.bak"):
        try:
            with open(name) as src:
                raw = json.load(src)
            known = {f.name for f in fields(Config)}
            if raw.get("schema_version", 0) > VERSION:
                raise ConfigError([f"schema_version {raw['schema_version']} is newer than {VERSION}"])
            values = {k: v for k, v in raw.items() if k in known}
            values |= {k: Profile(**values[k]) for k in ("standard", "low_quality") if k in values}
            return Config(**values | ({"policies": tuple(values["policies"])} if "policies" in values else {}))
        except (OSError, json.JSONDecodeError):
            continue
    return Config()
