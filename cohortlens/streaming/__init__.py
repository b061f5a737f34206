"""Structured Streaming entry points.

The cohort model itself has no streaming operators (no event time, windows,
watermarks or state). What arrives continuously in practice is narrative
drafts; :mod:`cohortlens.streaming.drafts` runs the figure verifier on them
as micro-batches against a static grounding-facts table.
"""
