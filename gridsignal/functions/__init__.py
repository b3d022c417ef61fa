"""Column expressions: no shuffle, no state."""
