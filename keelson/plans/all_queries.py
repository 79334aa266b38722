"""All queries outside the training-text part."""

from __future__ import annotations

from . import entity_queries, model_queries, scalar_queries  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
