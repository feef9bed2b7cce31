"""Readers and writers of logs, tiles and text forms."""
