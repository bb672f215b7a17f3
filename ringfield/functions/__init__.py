"""Column expressions; none of them runs Python for a row."""
