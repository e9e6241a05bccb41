"""Detector pipelines, verdict algebra, serving queries and the query catalogue."""
