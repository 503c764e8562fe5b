"""Catalog, storage layout and text ingestion of keyed tables."""
