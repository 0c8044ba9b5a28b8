"""Ingestion: track and identify requests, identities, sessions, enrichment; in batches and as streams."""
