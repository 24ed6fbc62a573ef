"""Structured Streaming forms of batch operators."""
