"""Relational operators: profiles, cross-column statistics, filters, joins, analytics."""
