"""Plans of the estimation engine."""
