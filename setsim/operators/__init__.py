"""Operators on collections: filters, indexes, joins, partitions, statistics, costs."""
