"""All queries of the library; importing this registers them."""

from __future__ import annotations

from tessera.plans import box_queries, camera_queries, detect_queries, learn_queries, mesh_queries, meshtool_queries, source_queries, surface_queries, volume_queries  # noqa: F401
from tessera.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
