"""Scalar expressions over track values."""
