"""Readers, writers and their text formats."""
