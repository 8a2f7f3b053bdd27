"""Structured Streaming forms: watermarks, late rows, keyed state."""
