"""Readers, writers, audits, and views over the driver tables."""
