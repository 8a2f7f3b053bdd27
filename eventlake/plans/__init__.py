"""Composite analytics jobs built from the operators."""
