"""Operators of a training-data pipeline. Self-contained: the rest of the library doesn't import it."""
