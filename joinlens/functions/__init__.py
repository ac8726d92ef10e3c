"""Functions of the estimation engine."""
