"""Streams of the same records."""
