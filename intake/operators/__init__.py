"""DataFrame operators of the intake engine."""
