"""Relational and geometric operators on cells."""
