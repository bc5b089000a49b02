"""Whole analyses, each a chain of operators."""
