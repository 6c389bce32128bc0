"""Diff operators."""
