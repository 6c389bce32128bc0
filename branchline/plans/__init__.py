"""Graphs, scopes, runs and promotions."""
