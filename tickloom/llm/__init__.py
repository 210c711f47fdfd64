"""Operators of a training-data pipeline.

Nothing else in the library imports this subpackage; it uses only general helpers
of the rest. Every operator is a function from DataFrames to a DataFrame.
"""
