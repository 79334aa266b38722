"""Intermediate tables in the folder that driver and executors share."""

from ..sources.scratch import materialize, shared_dir, workspace

__all__ = ["materialize", "shared_dir", "workspace"]
