"""Column functions: cleaning, parsing and keys."""
