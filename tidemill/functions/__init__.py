"""Expressions, predicates, variables and names."""
