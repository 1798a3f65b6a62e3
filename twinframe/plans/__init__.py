"""Whole jobs composed of the operators: generate, compare, report."""
