"""The query catalogue: each query as a DataFrame plan, with the same result in SQL."""
