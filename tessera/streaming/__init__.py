"""Structured Streaming versions of bars and recursions."""
