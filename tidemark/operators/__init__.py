"""operators of the tidemark engine."""
