"""Column functions: text, hashes, vectors."""
