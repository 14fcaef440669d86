"""Import every query module so that the registry is filled."""

from __future__ import annotations

from murmur.plans import (q_days, q_emotions, q_files, q_ingest, q_keywords, q_lookups, q_models, q_research,  # noqa: F401
                          q_rollups, q_streaming)
from murmur.plans.registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
