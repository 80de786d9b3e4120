"""Column expressions and distributed order statistics."""
