"""Report files, tables and results."""
