"""Operators package."""
