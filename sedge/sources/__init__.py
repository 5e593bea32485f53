"""Readers of uploaded files and writers of tables."""
