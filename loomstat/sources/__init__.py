"""Readers of tables, JSON lines, CSV and documents."""
