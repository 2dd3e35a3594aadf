"""Structured Streaming forms of the order-sensitive operators."""
