"""Sources of the estimation engine."""
