"""A PySpark engine for workbook analytics."""
