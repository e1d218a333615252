"""Column expressions: text and code functions. No Python runs per row."""
