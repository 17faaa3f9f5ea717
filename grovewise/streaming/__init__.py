"""Structured Streaming on top of a static forest."""
