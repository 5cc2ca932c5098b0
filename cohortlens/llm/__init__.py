"""Operators of a training-data pipeline, one module each, on Spark.

Nothing else in the library imports this subpackage.
"""
