"""Searchable, provable indexes over append-only logs, as Spark jobs."""
