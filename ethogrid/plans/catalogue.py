"""Every query of the library by name, and the SQL that checks it."""

from __future__ import annotations

from . import embeddings, frames, generation, masks, pixels, projects, relations, stacks, streams, tracking, training, warps  # noqa: F401  they register their queries
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
