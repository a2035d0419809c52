"""Whole lifecycles composed of operators."""
