"""All registered queries of the training-data operators and their oracles."""

from __future__ import annotations

from sievework.llm import groups, mixing, neardup, origin, packing, parsefail, percentiles, sentences

_MODULES = [groups, mixing, neardup, origin, packing, parsefail, percentiles, sentences]

QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE = {k: v for m in _MODULES for k, v in m.ORACLE.items()}
