"""Parameters that define the semantics of a placement run."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Optional


@dataclass(frozen=True)
class PlacementConfig:
    """One immutable parameter set, passed to operators explicitly.

    All lengths are in the scene unit (the depth and the poses share it).
    """

    # The names and defaults of the public parameters.
    voxel_size: float = 1.0
    pixel_stride: int = 4
    grid_padding: float = 10.0
    safety_margin: float = 0.5
    yaw_steps: int = 24
    min_surface_area: float = 50.0
    min_support_ratio: float = 1.0
    occlusion_threshold: float = 0.3
    dbscan_eps: Optional[float] = None
    dbscan_min_samples: int = 1
    preserve_orientation: bool = True
    orientation_threshold_deg: float = 15.0
    ransac_iterations: int = 192
    ransac_normal_z_min: float = 0.9
    ransac_seed: int = 0
    unit: str = "cm"

    @property
    def min_surface_voxels(self) -> int:
        """Smallest accepted surface, in voxels (never below one)."""
        return max(1, int(self.min_surface_area / (self.voxel_size * self.voxel_size)))
