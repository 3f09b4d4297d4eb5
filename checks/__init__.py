"""Queries over the provided tables, each next to the SQL that must give the same rows."""
