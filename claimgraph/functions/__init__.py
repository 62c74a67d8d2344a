"""Column expressions: identifiers, tokens, values."""
