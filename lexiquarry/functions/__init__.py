"""Column expressions: text, spans and statistics."""
