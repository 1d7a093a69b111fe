"""Column functions: coercion of cells, display text, phrase scores."""
