"""sources of the tidemark engine."""
