"""Column expressions and driver mathematics."""
