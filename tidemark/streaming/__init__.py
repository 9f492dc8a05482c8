"""streaming of the tidemark engine."""
