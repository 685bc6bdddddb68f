"""Structured Streaming: statements as they arrive."""
