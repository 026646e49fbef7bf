"""Spark-native analytics for conversational product search.

Every operator takes DataFrames (and plain parameters) and returns a lazily
composed DataFrame; Catalyst picks the physical plan.
"""
