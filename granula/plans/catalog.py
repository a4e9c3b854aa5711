"""Loads every query module into the registry."""

from . import clip_queries, io_queries, mesh_queries, population_queries, report_queries, scene_queries, search_queries, void_queries, voxel_queries  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
