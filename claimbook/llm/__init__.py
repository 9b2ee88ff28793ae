"""Operators for preparing training data: sharding, deduplication, encoding, scoring, screening."""
