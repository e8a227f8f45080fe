"""Column factories (aggregates and text encodings)."""
