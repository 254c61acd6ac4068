"""Column functions: text, coercion, resource arithmetic, variants."""
