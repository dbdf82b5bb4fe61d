"""Readers: relational tables, nested subtitle documents, page archives, fixed dimensions."""
