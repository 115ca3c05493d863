"""Operators over incidence tables."""
