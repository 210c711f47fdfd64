"""Spark-native analytics over prediction-market price streams.

Every operator is a plain ``DataFrame -> DataFrame`` function; the core ones
also run in Structured Streaming (see :mod:`tickloom.streaming`).
"""
from tickloom.params import Params

__all__ = ["Params"]
