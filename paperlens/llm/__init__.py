"""Operators of a training-data pipeline over large corpora.  Nothing else in the library imports this package."""
