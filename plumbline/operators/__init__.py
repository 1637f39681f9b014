"""Relational operators of the checks: DataFrame to DataFrame."""
