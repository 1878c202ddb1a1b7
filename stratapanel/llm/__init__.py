"""Operators for training-data pipelines: filters, deduplication, fingerprints, packing and scoring of texts."""
