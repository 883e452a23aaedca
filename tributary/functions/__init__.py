"""Scalar building blocks: casts, predicates, templates."""
