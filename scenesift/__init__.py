"""scenesift: object placement annotation over frames, as Spark DataFrame jobs."""

from scenesift.config import PlacementConfig
from scenesift.session import build_session

__all__ = ["PlacementConfig", "build_session"]
