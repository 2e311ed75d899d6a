"""Thresholds and switches of the engine, all in one frozen value."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class EngineConf:
    hide_sensitive: bool = True
    sensitive_threshold: float = 0.7
    similar_min_score: float = 0.75
    similar_limit: int = 60
    semantic_min_score: float = 0.15
    semantic_limit: int = 200
    text_limit: int = 300
    album_eps: float = 0.14
    album_eps_range: tuple[float, float] = (0.08, 0.20)
    album_min_points: int = 4
    album_min_rows: int = 12
    copy_max_bits: int = 3
    copy_min_cosine: float = 0.95
    copy_bit_range: tuple[int, int] = (5, 59)
    series_gap_ms: int = 60_000
    series_min_cosine: float = 0.92
    city_km: float = 30.0
    blurred_below: float = 100.0
    dark_below: float = 0.05
    large_video_bytes: int = 100 * 1024 * 1024
    knn_neighbours: int = 3
    knn_min_score: float = 0.42
    knn_margin: float = 0.05
    example_link: float = 0.35
    example_mode_link: float = 0.45
    artifact_score: float = 0.5
    collage_score: float = 0.8
    suggestion_score: float = 0.5
    topic_score: float = 0.25
    album_rebuild_points: int = 6
    refine_largest: int = 200
    refine_share: float = 0.05
    face_link: float = 0.57
    face_neighbours: int = 50
    same_photo_penalty: float = 1.1
    smallest_person: int = 2
    inherit_share: float = 0.4
    rebuild_pending: int = 50
    rebuild_hours: int = 24


#: The settings the operators take their defaults from.
CONF = EngineConf()
