"""Column expressions and vectorised scalar functions."""
