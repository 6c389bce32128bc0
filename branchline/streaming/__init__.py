"""Streams into snapshot tables."""
