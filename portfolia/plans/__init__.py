"""Registered queries and their SQL oracles, by theme."""

from __future__ import annotations

from portfolia.plans.registry import ORACLES, QUERIES
from portfolia.plans import (  # noqa: F401  (registration)
    documents, extensions, functions, governance, integration, ordered, quality, risk, semantic, sources, streaming,
)

__all__ = ["ORACLES", "QUERIES"]
