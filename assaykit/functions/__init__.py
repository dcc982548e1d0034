"""Column expressions: text, parsing, vectors and strict JSON."""
