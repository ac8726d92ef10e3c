"""Streaming of the estimation engine."""
