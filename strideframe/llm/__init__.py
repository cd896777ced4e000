"""Operators of a training-data pipeline over texts. Nothing else in the library imports this package."""
