"""Column expressions: text, clocks, arrays and test statistics."""
