"""Operators on DataFrames: chunking, search, retrieval, clustering, catalog, audit and ledgers."""
