"""plans of the tidemark engine."""
