"""Column functions: sequences and statistics."""
