"""Operators of a large-scale training-data pipeline, as Spark jobs.

Nothing else in the library imports this subpackage. Every operator takes a
DataFrame and column names and returns a DataFrame; ``registry`` holds the
queries that apply them to the test tables.
"""
