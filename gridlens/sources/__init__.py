"""Workbook packages as DataFrames."""
