"""Readers, writers, fingerprints and the result store."""
