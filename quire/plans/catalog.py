"""All queries of the document library."""

from __future__ import annotations

from . import analysis_queries, corpus_queries, file_queries, ledger_queries, page_queries, stream_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
