"""Column expressions and small distributed building blocks used by the operators."""
