"""Compositions of operators: SQL over sources, full profiles, reports."""
