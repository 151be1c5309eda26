"""Full-text indexing and ranked retrieval of papers, as DataFrame plans."""
