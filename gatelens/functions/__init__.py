"""Column expressions: predicates, scores, severities and text."""
