"""Whole queries over the registered tables."""
