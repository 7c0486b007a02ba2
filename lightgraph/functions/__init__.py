"""Column functions and small lookup tables."""
