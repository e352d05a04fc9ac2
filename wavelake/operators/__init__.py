"""Operators over trace and grid tables."""
