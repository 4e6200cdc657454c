"""Readers, fetchers and sinks."""
