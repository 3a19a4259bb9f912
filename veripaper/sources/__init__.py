"""Readers, writers and table changes."""
