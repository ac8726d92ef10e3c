"""Graphical models: graphs, distributions, inference and exchange formats."""
