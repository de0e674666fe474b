"""Importing this module registers every query."""

from marquee.catalog import enrichment, extraction, ranking, reports, scans  # noqa: F401
from marquee.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
