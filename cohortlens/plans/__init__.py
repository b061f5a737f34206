"""Composite plans: the baseline cohort table and the query catalogue built on it."""
