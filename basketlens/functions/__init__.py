"""Column helpers (semantics), exact distributed quantiles, broadcast checks."""
