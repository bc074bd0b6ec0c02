"""Readers and writers: envelopes, caches, CSV."""
