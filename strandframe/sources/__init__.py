"""Readers and writers of structure, constraint and design files."""
