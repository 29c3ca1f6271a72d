"""Core engine."""
