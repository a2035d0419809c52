"""Operators that prepare text and code for model training."""
