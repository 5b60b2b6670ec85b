"""Relational operators: filters, joins, aggregates, windows, result modes."""
