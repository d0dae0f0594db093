"""Readers and writers for case sets, run artifacts, listings and catalogs."""
