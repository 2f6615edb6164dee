"""Column-expression factories."""
