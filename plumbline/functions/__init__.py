"""Column expressions used across the operators."""
