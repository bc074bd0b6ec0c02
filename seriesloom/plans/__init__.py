"""Registered queries, composed stages and the stage runner."""
