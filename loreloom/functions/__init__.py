"""Functions package."""
