"""Operators over DataFrames; retrieval operators take a batch of queries (query_id, ...)."""
