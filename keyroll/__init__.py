"""keyroll package."""
