"""Readers, writers and the canonical inputs derived from the shared tables."""
