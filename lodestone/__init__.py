"""Lodestone: evidence-graph and text-corpus processing written as ordinary PySpark jobs."""
