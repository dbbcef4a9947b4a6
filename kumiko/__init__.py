"""Versioned, document-derived reference data on Spark: catalogues, lookups, search, quality rules and table reconstruction."""
