"""The spreadsheet function library on Spark columns."""
