"""Operators of a large-scale training-data pipeline.

Every operator is a function from DataFrames to a DataFrame; ``queries.py`` registers one
query per operator.  Nothing outside this package imports it.
"""
