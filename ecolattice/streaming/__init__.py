"""Draws as a stream."""
