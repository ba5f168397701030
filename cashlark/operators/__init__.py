"""Relational building blocks: dedup, filters, joins, aggregates, paging and sets."""
