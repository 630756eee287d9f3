"""Whole commands, from files to files."""
