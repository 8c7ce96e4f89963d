"""Retrieval evaluation and corpus preparation as Spark DataFrames."""
