"""Cohort-economics operators: every function maps DataFrame -> DataFrame."""
