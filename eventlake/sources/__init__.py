"""Readers: files, CSV tables, message topics, in-memory rows."""
