"""Workbooks arriving in a folder."""
