"""Plans package."""
