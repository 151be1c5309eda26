"""Column expressions, and the few Arrow functions that no expression can replace."""
