"""Structured Streaming jobs over behaviour events."""
