"""Structured Streaming folds of the scan-progress feed."""
