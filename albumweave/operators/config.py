"""Thresholds, as fixed values; 0 turns a gate off."""

from __future__ import annotations

from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Thresholds:
    pair_similarity: float = 0.45
    duplicate: float = 0.985
    same_photo_exempt: float = 0.95
    merge_centroid: float = 0.55
    merge_pair_mean: float = 0.475
    rescue: float = 0.60
    margin_floor: float = 0.40
    margin_ratio: float = 1.7
    membership: float = 0.40
    membership_margin: float = 0.05
    grey_ceiling: float = 0.46
    grey_pair: float = 0.45
    main_face_ratio: float = 0.5
    lonely_face: float = 0.185
    small_face_px: float = 100.0
    low_res_long_side: float = 2000.0
    album_pair: float = 0.35
    assign: float = 90.0
    suggest: float = 85.0
    fragment_hint: float = 95.0
    unanimous: float = 90.0
    unanimous_spread: float = 5.0
    doll: float = 90.0
    sculpture: float = 70.0
    background_width: float = 0.025
    large_width: float = 0.20
    large_score: float = 0.70
    small_score: float = 0.60
    false_score: float = 0.78
    false_aspect: float = 0.70
    promote: float = 0.45
    promote_floor: float = 0.40
    match: float = 0.0
    epsilon: float = 0.15
    min_size: int = 2
    min_samples: int = 2
    candidates: int = 3
    representatives: int = 2
    #: Group photos are shown in the common album, also if their people have albums; else only those nobody of whom has.
    group_photo_to_common: bool = True
    #: A photo of an album is listed as uncertain, too, if a main face of it has none.
    unmatched_main_to_uncertain: bool = True

    def __post_init__(self) -> None:
        for f in fields(self):
            value = getattr(self, f.name)
            if value < 0:
                raise ValueError(f"{f.name} is below 0: {value}")
        if not self.suggest <= self.assign:
            raise ValueError("suggest must not exceed assign")
        if self.membership and self.grey_ceiling and self.grey_ceiling < self.membership:
            raise ValueError("grey_ceiling must not be below membership")
        if self.promote_floor > self.promote:
            raise ValueError("promote_floor must not exceed promote")
        for name in ("promote", "promote_floor", "match", "duplicate", "same_photo_exempt", "merge_centroid", "merge_pair_mean", "rescue", "margin_floor", "membership", "grey_ceiling", "grey_pair", "lonely_face", "album_pair", "background_width", "large_width"):
            if getattr(self, name) > 1:
                raise ValueError(f"{name} is above 1")
