"""Incremental versions of operators on streams."""
