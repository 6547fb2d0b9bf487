"""Operators for large text corpora: tokenising, de-duplication, scoring, scanning, sharding."""
