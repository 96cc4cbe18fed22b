"""Statistics, bounds and plan decisions."""
