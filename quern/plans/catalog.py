"""The queries over the tables, gathered from the modules of this package."""

from __future__ import annotations

from ..operators import bm25
from . import knowledge, measures, more, searches, texts
from .common import table

_MODULES = (texts, searches, measures, more, knowledge)


def flagship(spark, sf_dir: str):
    """BM25 ranking of all recorded questions against the clauses."""
    t = table
    return bm25.top_k(t(spark, sf_dir, "clauses"), t(spark, sf_dir, "eval_rigor_results_v1_pre_guard"), "clause_id", "original_text", "id", "question")


def queries() -> dict:
    return {k: v for m in _MODULES for k, v in m.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _MODULES for k, v in m.oracle_sql().items()}
