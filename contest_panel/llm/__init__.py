"""Operators for large text corpora: ten numbered ones, each in a module of its own, and their queries."""
