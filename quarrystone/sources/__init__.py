"""Readers: tables, files, documents and paged interfaces."""
