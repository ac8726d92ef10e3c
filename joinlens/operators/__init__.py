"""Operators of the estimation engine."""
