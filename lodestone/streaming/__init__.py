"""Interviews whose answers arrive as a stream."""
