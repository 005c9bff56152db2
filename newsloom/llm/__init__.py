"""Operators of a training-data pipeline: each module holds one, ``queries`` binds them to the tables."""
