"""Operators of a training-data pipeline, on top of the library."""
