"""Importing this package registers all queries of the engine."""

from . import analytics, composites, graphs, lifecycle, records, relational, requests, retrieval, upkeep  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
