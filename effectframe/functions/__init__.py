"""Column expressions: no shuffle, no Python per row."""
