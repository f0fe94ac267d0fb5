"""All queries of the engine's own operators."""

from __future__ import annotations

from . import q_association, q_genotypes, q_haplotypes, q_intervals, q_ld, q_models, q_scan, q_sources, q_stability  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
