"""Operators of a training-data pipeline over raw documents, and their registered queries."""
