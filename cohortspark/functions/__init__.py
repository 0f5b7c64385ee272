"""Column functions: they take columns or names and return columns."""
