"""Sinks: general CSV, accounting import, workbook, result lines; checks before a write."""
