"""Readers, normalisers of landed payloads, and writers."""
