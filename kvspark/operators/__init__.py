"""Operators over key-value DataFrames."""
