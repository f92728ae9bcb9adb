"""Scalar functions as Column expressions, with Python twins for the driver side."""
