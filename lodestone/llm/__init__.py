"""Operators that prepare text and extracted records for model training. Nothing else in the library imports this."""
