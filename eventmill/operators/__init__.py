"""Operators over event tables: filters, derived columns, joins, entity resolution, facets, orders."""
