"""Bundled grammars, as text for ``sievework.llm.chart``."""
