"""DataFrame operators, by family."""
