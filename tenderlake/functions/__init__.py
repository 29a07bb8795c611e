"""Column expressions: rule lists, labels, measures and predicates."""
