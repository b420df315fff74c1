"""Operators that a training-data pipeline needs, beside the engine's own.

Nothing else in the library imports this package; ``registry`` lists its queries.
"""
