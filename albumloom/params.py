"""Tunable values of the library, one frozen dataclass per area."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Chunking:
    """Filtering, duplicate removal and batch building."""

    min_size_bytes: int = 30 * 1024
    min_side_px: int = 400
    max_aspect: float = 3.0
    dup_max_bits: int = 2
    burst_seconds: int = 90
    hard_cut_seconds: int = 30 * 60
    segment_max_bits: int = 22
    merge_max_bits: int = 18
    merge_span_seconds: int = 60 * 60
    max_batch: int = 10
    small_batch: int = 3
    small_gap_seconds: int = 8 * 60

    @property
    def min_side(self) -> int:
        """Fewest photos on either side of a split."""
        return max(2, self.max_batch // 4)


@dataclass(frozen=True)
class Placing:
    """Coordinate enrichment."""

    home_city: str = "重庆市"
    poi_radius_m: float = 500.0
    poi_blacklist: tuple[str, ...] = ()
    min_score: int = 35
    min_score_home: int = 65


@dataclass(frozen=True)
class Curation:
    """Batched decisions and their retries."""

    force_keep: bool = False
    retry_group: int = 2
    failure_limit: int = 5
    window_seconds: int = 300


@dataclass(frozen=True)
class Themes:
    """Day merging and multi-year themes."""

    day_merge_threshold: int = 1
    min_events: int = 2
    min_year_span: int = 1
    batch_size: int = 100
    theme_batch: int = 2000


@dataclass(frozen=True)
class Tasks:
    """Upload and analysis task state."""

    idle_seconds: int = 30 * 60
    max_age_seconds: int = 2 * 3600
    heartbeat_seconds: int = 60
    retention_seconds: int = 24 * 3600
    max_upload_bytes: int = 10 * 1024**3


@dataclass(frozen=True)
class Matching:
    """Removal list against a gallery."""

    size_tolerance: int = 1024
    time_tolerance_ms: int = 12 * 3600 * 1000
    warn_after_ms: int = 2000
