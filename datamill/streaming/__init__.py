"""Incremental work on growing tables."""
