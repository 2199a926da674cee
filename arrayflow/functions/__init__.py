"""Column expressions and skew-safe ordered building blocks."""
