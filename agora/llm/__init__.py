"""Operators of a training-data pipeline (one module each), their registered queries and their SQL."""
