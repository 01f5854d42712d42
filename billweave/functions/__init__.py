"""Scalar column functions: decimals, text, header classification."""
