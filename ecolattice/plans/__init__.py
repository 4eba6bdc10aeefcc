"""Calculations put together from operators."""
