"""Column expressions: type names, identifiers, statements and value texts."""
