"""Operators of a training-data pipeline over the corpus tables.

Nothing else in the library imports this subpackage; ``queries`` registers one
query per operator and ``sql`` holds the DuckDB SQL of those it can express.
"""
