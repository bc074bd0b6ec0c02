"""Structured Streaming twins of the run and tracker operators."""
