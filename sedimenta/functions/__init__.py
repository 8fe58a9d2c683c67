"""Column expressions: cleaning, parsing and hashing."""
