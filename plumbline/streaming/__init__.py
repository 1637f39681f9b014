"""Incremental checks as a stream of changed files."""
