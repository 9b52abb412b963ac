"""Paired-contest and per-entity sequence analytics on Spark DataFrames."""
