"""Scalar, array and statistical column expressions."""
