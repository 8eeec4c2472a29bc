"""Sources package."""
