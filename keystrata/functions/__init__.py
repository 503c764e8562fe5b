"""Column types and conversions of keyed tables."""
