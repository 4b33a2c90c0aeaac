"""Declared extensions over unbounded input."""
