"""All registered queries of the core and their oracles."""

from __future__ import annotations

from sievework.plans import detector_queries, sample, snapshots, tables

_MODULES = [snapshots, tables, detector_queries, sample]

QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE = {k: v for m in _MODULES for k, v in m.ORACLE.items()}
FLAGSHIP = QUERIES["near_dup_documents"]
