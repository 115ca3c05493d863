"""Column expressions: orientations, cell types, vectors."""
