"""The engine's queries: importing this module fills the registry."""

from __future__ import annotations

from scriptorium.plans import chunk_queries, curation_queries, evaluation_queries, retrieval_queries, structure_queries, text_queries  # noqa: F401
from scriptorium.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]

FLAGSHIP = "ret13_hybrid"
