"""Column functions: text, vectors, guard rules."""
