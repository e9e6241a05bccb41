"""Reusable DataFrame kernels: clustering, joins, graphs, diffs, statistics."""
