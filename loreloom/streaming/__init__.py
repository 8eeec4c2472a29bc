"""Streaming package."""
