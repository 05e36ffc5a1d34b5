"""Retrieval, knowledge-graph and evaluation operators for Spark DataFrames."""
