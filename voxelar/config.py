"""Map parameters and the profiles of the entry points."""

from __future__ import annotations

import dataclasses


@dataclasses.dataclass(frozen=True)
class MapConfig:
    voxel_size: float = 0.02
    overlap_radius: float = 0.04
    max_centroid_distance: float = 1.0
    min_geometric_overlap: float = 0.05
    min_box_overlap: float = 0.0
    association_threshold: float = 0.45
    geometry_weight: float = 0.7
    semantic_weight: float = 0.3
    cluster_eps: float = 0.10
    cluster_min_points: int = 10
    max_extent_growth: float = 2.0
    association_max_points: int = 4096
    denoise_interval: int = 0
    merge_interval: int = 20
    merge_overlap: float = 0.80
    min_confirmed: int = 3
    max_missed: int = 30
    stale_after: float = 0.0

    def __post_init__(self) -> None:
        if self.voxel_size <= 0 or self.overlap_radius <= 0:
            raise ValueError("voxel size and overlap radius must be positive")
        if min(self.geometry_weight, self.semantic_weight) < 0 or self.geometry_weight + self.semantic_weight <= 0:
            raise ValueError("weights must not be negative and need a positive sum")


# The defaults of each entry point.
_STRICT = {"max_centroid_distance": 0.75, "min_geometric_overlap": 0.08, "association_threshold": 0.5, "max_extent_growth": 1.5, "merge_interval": 0, "min_confirmed": 8}
PROFILES = {"default": MapConfig(), "offline": MapConfig(**_STRICT), "deployed": MapConfig(**_STRICT, cluster_eps=0.0)}
