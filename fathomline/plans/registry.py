"""The registered queries and their SQL."""

from __future__ import annotations

from . import duplicates, entities, library, pages, records, retrieval, texts  # noqa: F401  importing registers their queries
from .base import ORACLE_SQL, QUERIES

FLAGSHIP = QUERIES["r11_search"]

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
