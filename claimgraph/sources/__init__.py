"""Readers that turn files and tables into artifact rows."""
