"""Column expressions; no function here adds a shuffle."""
