"""Palisade: permission-aware retrieval analytics on Spark DataFrames."""
