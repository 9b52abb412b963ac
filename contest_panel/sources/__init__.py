"""Readers and writers for season, live, cohort and example tables."""
