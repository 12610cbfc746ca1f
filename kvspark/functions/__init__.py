"""Scalar functions over bytes and 64-bit numbers."""
