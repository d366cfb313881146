"""Batch reconciliation of library-catalogue listings, holdings and lookups as Spark jobs."""
