"""Structured Streaming operators; each also runs on a static table."""
