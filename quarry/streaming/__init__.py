"""Structured Streaming forms of the operators that keep keyed state."""
