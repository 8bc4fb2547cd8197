"""Readers and writers: files, notebooks, object listings, tables, catalog."""
