"""Column expressions: identifiers, times, numbers, categories, rule texts and formulas."""
