"""Structured Streaming forms of operators that keep keyed state."""
