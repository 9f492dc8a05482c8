"""functions of the tidemark engine."""
